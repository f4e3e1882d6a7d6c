"""Rule packs: extraction rules as rows, and the registry of packs per (client, format)."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from docfields.schema import EXTRACTION_RULES


@dataclass(frozen=True)
class Rule:
    """One ordered pattern of one field.

    ``take`` is ``first`` (only the first match is looked at) or ``all`` (matches in order until one is
    accepted) or ``context`` (as ``all``, the guard also sees 50 characters around the match). ``prepare``
    is applied to the text before matching. ``normaliser`` and ``guard`` name entries of ``docfields.operators.extract``.
    """

    client_id: int
    format_id: int
    field: str
    rule_no: int
    take: str
    pattern: str
    group: int = 1
    normaliser: str = "trim"
    guard: str = "present"
    prepare: str = "as_is"


class RulePack:
    """Rules of one (client, format) plus the derived columns of its record."""

    def __init__(self, client_id: int, format_id: int, rules: list[Rule], finish=None, mapping=None):
        self.key = (client_id, format_id)
        self.rules = rules
        self.finish = finish
        self.mapping = mapping

    def fields(self) -> list[str]:
        return list(dict.fromkeys(r.field for r in self.rules))

    def of(self, field: str) -> list[Rule]:
        return sorted((r for r in self.rules if r.field == field), key=lambda r: r.rule_no)


_PACKS: dict[tuple[int, int], RulePack] = {}


def register_rule_pack(client_id: int, format_id: int, rules: list[Rule], finish=None, mapping=None) -> RulePack:
    """V1/V2: make a pack known; a later registration replaces an earlier one."""
    pack = RulePack(client_id, format_id, rules, finish, mapping)
    _PACKS[pack.key] = pack
    return pack


def rule_pack(client_id: int, format_id: int) -> RulePack:
    _load_builtin()
    return _PACKS[(client_id, format_id)]


def registered() -> list[tuple[int, int]]:
    _load_builtin()
    return sorted(_PACKS)


def _load_builtin() -> None:
    from docfields.rules import freight_a, freight_b, freight_c  # noqa: F401


def rules_frame(spark: SparkSession) -> DataFrame:
    """All registered rules as a table."""
    _load_builtin()
    rows = [astuple(r) for key in sorted(_PACKS) for r in _PACKS[key].rules]
    return spark.createDataFrame(rows, EXTRACTION_RULES)


def numbered(client_id: int, format_id: int, field: str, patterns, **common) -> list[Rule]:
    """Patterns in priority order to rules; an entry may be (pattern, overrides)."""
    out = []
    for no, entry in enumerate(patterns, 1):
        pattern, extra = entry if isinstance(entry, tuple) else (entry, {})
        out.append(Rule(client_id, format_id, field, no, **{"take": "first", "pattern": pattern, **common, **extra}))
    return out
