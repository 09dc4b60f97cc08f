"""Rule, typology and routing configuration, as plain driver-side documents."""
from .rules import EVENT_FLOW, RULES, rule_config, tenant_rule_configs
from .typologies import NETWORK_MAPS, TYPOLOGIES

__all__ = ["EVENT_FLOW", "RULES", "rule_config", "tenant_rule_configs", "NETWORK_MAPS", "TYPOLOGIES"]
