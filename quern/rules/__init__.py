"""Detection rules: each turns parsed tables into findings, as one declarative query over all snapshots."""

from . import exc, gca, his, tda
from .base import FINDING, Rule, Tables, rule_of

RULES: list[Rule] = [*tda.RULES, *gca.RULES, *his.RULES, *exc.RULES]

__all__ = ["FINDING", "RULES", "Rule", "Tables", "rule_of"]
