"""Behaviour rules, evaluated for every payment of the history at once."""
from .registry import FAMILIES, evaluate_rule, evaluate_rules, register_rule

__all__ = ["FAMILIES", "evaluate_rule", "evaluate_rules", "register_rule"]
