from .scalar import haversine, leading_digit, levenshtein_distance

__all__ = ["haversine", "leading_digit", "levenshtein_distance"]
