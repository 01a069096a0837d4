"""Channel and marker names: normalisation against a panel, and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blank_to_null(c: str | Column) -> Column:
    """White-space-only text as null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(x), F.lit(""))


@dataclass
class NameRule:
    """A standard name with the pattern, and the exact alternatives, that stand for it.

    Alternatives count whatever the case rule is.
    """

    standard: str
    regex: str = ""
    permutations: str = ""
    case_sensitive: bool = False

    def matches(self, c: Column) -> Column:
        found = F.lit(False)
        if self.regex:
            found = c.rlike(self.regex if self.case_sensitive else f"(?i){self.regex}")
        if self.permutations:
            found = found | F.array_contains(F.array(*[F.lit(p.strip()) for p in self.permutations.split(",")]), F.trim(c))
        return F.coalesce(found, F.lit(False))


@dataclass
class Panel:
    """Rules for channels and markers, and the pairs that belong together (null marker as empty)."""

    channels: list[NameRule] = field(default_factory=list)
    markers: list[NameRule] = field(default_factory=list)
    mappings: list[tuple[str, str | None]] = field(default_factory=list)

    @classmethod
    def from_dict(cls, x: dict) -> Panel:
        rule = lambda name, y: NameRule(name, y.get("regex", ""), y.get("permutations", ""), bool(y.get("case", y.get("case_sensitive", False))))
        return cls([rule(k, v) for k, v in x.get("channels", {}).items()], [rule(k, v) for k, v in x.get("markers", {}).items()], [(m["channel"], m["marker"]) if isinstance(m, dict) else tuple(m) for m in x.get("mappings", [])])

    @classmethod
    def of_features(cls, features: list[str]) -> Panel:
        """Every feature stands for itself."""
        import re

        rules = [NameRule(f, f"^{re.escape(f)}$", case_sensitive=True) for f in features]
        return cls(rules, list(rules), [(f, f) for f in features])

    def check(self) -> list[str]:
        """What is wrong with the panel: repeated standard names, and mapped names that no rule defines."""
        out = []
        for kind, rules in (("channel", self.channels), ("marker", self.markers)):
            names = [r.standard for r in rules]
            out += [f"duplicate {kind} {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        channels, markers = {r.standard for r in self.channels}, {r.standard for r in self.markers}
        out += [f"undefined channel {c}" for c, _ in self.mappings if c and c not in channels]
        out += [f"undefined marker {m}" for _, m in self.mappings if m and m not in markers]
        return out

    @classmethod
    def from_tables(cls, nomenclature: DataFrame, mappings: DataFrame) -> Panel:
        """From two small tables, as `spark.read.csv` gives them: nomenclature(name, regex, permutations, case, kind: channel or marker) and mappings(channel, marker)."""
        for df, wanted in ((nomenclature, {"name", "regex", "permutations", "case", "kind"}), (mappings, {"channel", "marker"})):
            if missing := wanted - set(df.columns):
                raise ValueError(f"no column {', '.join(sorted(missing))}")
        rules: dict[str, list[NameRule]] = {"channel": [], "marker": []}
        for r in nomenclature.orderBy("name").collect():
            rules[r.kind].append(NameRule(r.name, r.regex or "", r.permutations or "", str(r.case).lower() in ("1", "true", "yes")))
        return cls(rules["channel"], rules["marker"], [(r.channel, r.marker) for r in mappings.orderBy("channel").collect()])

    def to_dict(self) -> dict:
        rule = lambda r: {"regex": r.regex, "permutations": r.permutations, "case": r.case_sensitive}
        return {"channels": {r.standard: rule(r) for r in self.channels}, "markers": {r.standard: rule(r) for r in self.markers}, "mappings": [channel_map(c, m) for c, m in self.mappings]}

    def list_channels(self) -> list[str]:
        return [r.standard for r in self.channels]

    def list_markers(self) -> list[str]:
        return [r.standard for r in self.markers]


def normalised(c: str | Column, rules: list[NameRule]) -> Column:
    """The standard names that match, as an array: one is a match, none or several are for the caller to judge."""
    x = blank_to_null(c)
    return F.filter(F.array(*[F.when(r.matches(x), F.lit(r.standard)) for r in rules]), lambda n: n.isNotNull())


def normalise(df: DataFrame, column: str, rules: list[NameRule], to: str) -> DataFrame:
    """Adds `to` (the one matching name, else null) and `<to>_matches` (how many match)."""
    found = normalised(column, rules)
    return df.withColumn(f"{to}_matches", F.size(found)).withColumn(to, F.when(F.size(found) == 1, found[0]))


def standardise(df: DataFrame, panel: Panel, channel: str = "channel", marker: str = "marker") -> DataFrame:
    """Standard channel and marker of each row; a blank one is derived from its partner by the panel's pairs. Both missing is an error (raised when read)."""
    ch, mk = normalised(channel, panel.channels), normalised(marker, panel.markers)
    of_channel = {c: m for c, m in panel.mappings if m}
    of_marker = {m: c for c, m in panel.mappings if m}
    look = lambda pairs, x: F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[x] if pairs else F.lit(None).cast("string")
    one = lambda found, raw: F.when(blank_to_null(raw).isNull(), None).when(F.size(found) == 1, found[0]).otherwise(F.raise_error(F.concat(F.lit("no single standard name for "), F.col(raw))))
    c, m = one(ch, channel), one(mk, marker)
    both = F.when(c.isNull() & m.isNull(), F.raise_error(F.lit("channel and marker are both missing")).cast("string"))
    return df.withColumns({channel: F.coalesce(c, both, look(of_marker, m)), marker: F.coalesce(m, look(of_channel, c))})


def channel_map(channel: str | None, marker: str | None) -> dict[str, str]:
    """A pair as a record, missing names as empty."""
    return {"channel": channel or "", "marker": marker or ""}


def matched(channel: Column, marker: Column, other_channel: Column, other_marker: Column) -> Column:
    """Whether two pairs are the same, missing names as empty."""
    plain = lambda c: F.coalesce(c, F.lit(""))
    return (plain(channel) == plain(other_channel)) & (plain(marker) == plain(other_marker))


def standard_names(spark: SparkSession, mappings: list[tuple[str, str | None]], panel: Panel, missing: str = "raise") -> list[tuple[str, str | None]]:
    """The pairs of a file in the panel's names, in their order: each must be a pair of the panel, none may occur twice, and no channel of the
    panel may be absent (missing='warn' lets it pass)."""
    df = spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(mappings)], "i int, channel string, marker string")
    done = standardise(df, panel).orderBy("i").collect()  # a row for each channel
    found = [(r.channel, r.marker) for r in done]
    known = {tuple(channel_map(c, m).values()) for c, m in panel.mappings}
    if odd := [f"{c}/{m or ''}" for c, m in found if tuple(channel_map(c, m).values()) not in known]:
        raise ValueError(f"not a pair of the panel: {', '.join(odd)}")
    if again := sorted({str(n) for k in (0, 1) for n in (p[k] for p in found) if n and [p[k] for p in found].count(n) > 1}):
        raise ValueError(f"occurs twice: {', '.join(again)}")
    if (absent := sorted({c for c, _ in panel.mappings if c} - {c for c, _ in found})) and missing == "raise":
        raise ValueError(f"missing channels: {', '.join(absent)}")
    return found


def chunks(df: DataFrame, size: int, id_col: str = "event_id") -> DataFrame:
    """df with `chunk`: consecutive ids, `size` at a time."""
    return df.withColumn("chunk", F.floor(F.col(id_col) / size))


def paired(df: DataFrame, mappings: DataFrame) -> DataFrame:
    """Rows whose (channel, marker) is a pair of the mappings; nulls count as empty."""
    left = df.withColumns({"_c": F.coalesce("channel", F.lit("")), "_m": F.coalesce("marker", F.lit(""))})
    right = mappings.select(F.coalesce("channel", F.lit("")).alias("_c"), F.coalesce("marker", F.lit("")).alias("_m"))
    return left.join(right, ["_c", "_m"], "left_semi").drop("_c", "_m")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Non-blank names that occur more than once, with their count."""
    return df.select(blank_to_null(column).alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def missing_channels(expected: DataFrame, found: DataFrame, column: str = "channel") -> DataFrame:
    """Expected names that aren't there."""
    return expected.select(column).distinct().join(found.select(column), column, "left_anti")


def column_names(channels: list[str], markers: list[str | None], prefer: str = "markers") -> list[str]:
    """For each column the preferred name, else the other."""
    first, second = (markers, channels) if prefer == "markers" else (channels, markers)
    return [(a or "").strip() or (b or "").strip() for a, b in zip(first, second, strict=True)]


def spill_matrix(keyword: str) -> tuple[list[str], list[list[float]]]:
    """Channels and rows of a `n,ch1,...,chn,v11,...,vnn` keyword."""
    parts = [p.strip() for p in keyword.split(",")]
    n = int(parts[0])
    values = [float(v) for v in parts[n + 1 : n + 1 + n * n]]
    if len(values) != n * n:
        raise ValueError("the matrix isn't complete")
    return parts[1 : n + 1], [values[i * n : (i + 1) * n] for i in range(n)]
