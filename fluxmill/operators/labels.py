"""Labels: JSON metadata, chains of conditions, payload patterns and signatures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"


def parsed(label: str | Column) -> Column:
    """A label as map of key -> array of texts; legacy 'k=v:k=v' included. Broken, empty and null labels give no keys."""
    c = F.col(label) if isinstance(label, str) else label
    json = F.from_json(c, MAP)
    legacy = F.when(~F.trim(c).startswith("{") & c.contains("="), F.str_to_map(c, F.lit(":"), F.lit("=")))
    both = F.map_filter(F.coalesce(legacy, json, F.create_map().cast(MAP)), lambda k, v: v.isNotNull() & (k != ""))
    listed = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>"))
    return F.transform_values(both, lambda k, v: F.coalesce(listed(v), F.array(v)))


def union(a: Column, b: Column) -> Column:
    """Two parsed labels as one: values of a key are united, equal values once, sorted."""
    none = F.array().cast("array<string>")
    joined = F.map_zip_with(a, b, lambda k, x, y: F.array_sort(F.array_union(F.coalesce(x, none), F.coalesce(y, none))))
    return joined


def text(label: Column) -> Column:
    """A parsed label as JSON with sorted keys; null when there is none."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(label)))
    return F.when(F.size(label) > 0, F.to_json(ordered))


def merged_labels(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the union of all labels, as JSON. Values are made distinct before they are gathered."""
    pairs = df.select(*keys, F.explode(parsed("label")).alias("_k", "_vs")).select(*keys, "_k", F.explode("_vs").alias("_v")).distinct()
    per_key = pairs.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
    rows = per_key.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("_m"))
    return rows.select(*keys, F.to_json("_m").alias("label"))


def flow_labels(df: DataFrame, rules: list[tuple[str, str, bool]], name: str = "tags") -> DataFrame:
    """Adds the names of the filters a record passes, joined by ':'. (filter, name, cont): without cont the first ends it."""
    from ..plans.filterlang import compile_filter

    parts, open_ = [], F.lit(True)
    for filter_text, tag, cont in rules:
        hit = F.coalesce(compile_filter(filter_text, set(df.columns)), F.lit(False))
        parts.append(F.when(open_ & hit, F.lit(tag)))
        if not cont:
            open_ &= ~hit
    joined = F.array_join(F.array_compact(F.array(*parts)), ":")
    return df.withColumn(name, F.when(joined != "", joined))


def payload_text(c: str) -> Column:
    """Payload bytes as text, one character a byte, so that patterns see all bytes."""
    return F.decode(F.col(c), "ISO-8859-1")


def grep(df: DataFrame, patterns: list[str], invert: bool = False, ignore_case: bool = False) -> DataFrame:
    """Records whose payload matches a pattern: 's:re' source, 'd:re' destination, 're' either. Null payload never matches."""
    hit = F.lit(False)
    for p in patterns:
        side, sep, body = p.partition(":")
        columns, expression = ({"s": ["suser"], "d": ["duser"]}[side], body) if sep and side in ("s", "d") else (["suser", "duser"], p)
        for c in columns:
            hit |= F.coalesce(payload_text(c).rlike(("(?i)" if ignore_case else "") + expression), F.lit(False))
    return df.where(~hit if invert else hit)


@dataclass(frozen=True)
class Signature:
    """A service's payload: hex digits from the first byte on, '?' for any digit; the port is a hint."""

    service: str
    proto: int
    port: int
    side: str
    pattern: str

    def regex(self) -> str:
        return "^" + self.pattern.upper().replace("?", ".")

    def weight(self) -> int:
        return sum(c != "?" for c in self.pattern)


def match_signatures(df: DataFrame, signatures: list[Signature], least: int = 5) -> DataFrame:
    """Adds service: of the matching signatures the one with most fixed digits, a fitting port counting 1,000 more.

    Matches with ``least`` fixed digits or fewer need the port.
    """
    options = []
    for s in sorted(signatures, key=lambda s: (s.service, s.port)):
        fits = F.coalesce((F.col("proto") == s.proto) & F.hex("suser" if s.side == "src" else "duser").rlike(s.regex()), F.lit(False))
        at_port = F.coalesce((F.col("dport") == s.port) | (F.col("sport") == s.port), F.lit(False))
        points = F.when(at_port, 1000 + s.weight()).when(F.lit(s.weight() > least), s.weight())
        options.append(F.when(fits & points.isNotNull(), F.struct(points.alias("points"), F.lit(s.service).alias("service"))))
    best = F.array_max(F.array_compact(F.array(*options)))
    return df.withColumn("service", best["service"])


def way() -> Column:
    """Direction by locality (3 and above is inside): 'inside', 'out', 'in', 'outside', or 'unknown' where neither is known."""
    near, far = F.col("sloc") >= 3, F.col("dloc") >= 3
    return F.when(near & far, "inside").when(near, "out").when(far, "in").when(F.col("sloc").isNull() & F.col("dloc").isNull(), "unknown").otherwise("outside")


def available(proto: int, port: int) -> Column:
    """Whether a record shows the service at a port answering: established for TCP, packets from the server for both; null
    for records of anything else."""
    answered = F.coalesce("dpkts", F.lit(0)) > 0
    if proto == 6:
        answered &= F.coalesce(F.col("status").bitwiseAND(F.lit(4)), F.lit(0)) != 0
    return F.when((F.col("proto") == proto) & (F.col("dport") == port), answered)
