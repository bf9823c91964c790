"""Secret scans: single patterns, and weak parts of credentials that count only together.

Assignments, access keys and long hexadecimal runs are reported wherever they stand. Identifiers, random-looking runs
and endpoints are weak: they are reported only when complementary parts stand within the same scope and apart from each
other, which an interval join over cells of that width finds: a part asks for ends of others before its start and for
starts after its end. A cell keeps the first and last place of each role, so that the join has a row per cell and never
one per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import settle, text_of

#: The patterns of the kinds that are always reported, and the group that must have the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Weak kinds.
IDENTIFIER = r"""(?i:client_?id|account_?id|key_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
#: Runs and endpoints are matched in one scan, so that what is inside an endpoint is no run.
RUNS = f"{ENDPOINT}|{RANDOM}"

#: Kinds in the order in which spans with equal starts are listed, with the role of each as a part of a credential.
KINDS = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "random": "secret", "endpoint": "endpoint"}
BASE = ("assign", "access", "hex")
#: The roles that must stand near a weak part of a role: one of them is enough.
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_BLOCK = 256


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column, start: Column) -> Column:
    """start, start + sizes[0], start + sizes[0] + sizes[1], ...: as many as sizes has."""
    begin = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    return F.aggregate(sizes, begin, step)["out"]


def _starts(sizes: Column) -> Column:
    """Running sums before each element, by blocks: a text with very many matches costs no square of their number."""

    def by_blocks(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))
        whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
        return _bind(blocks, lambda bs: F.flatten(F.zip_with(bs, _running(F.transform(bs, whole), F.lit(0)), _running)))

    return _bind(sizes, by_blocks)


def _found(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """Spans (start, place, stop, kind) of a pattern's leftmost matches, code points from 0.

    The pieces between the matches and the matches alternate, so their lengths give the starts. keep(match, index)
    drops matches after they have used up their part of the text.
    """
    place = list(KINDS).index(kind)
    none = F.array().cast("array<struct<start:bigint,place:int,stop:bigint,kind:string>>")

    def spans(hits: Column) -> Column:
        pieces = F.split(text, pattern)
        sizes = F.zip_with(F.slice(pieces, 1, F.size(hits)), F.concat(F.array(F.lit("")), F.slice(hits, 1, F.size(hits) - 1)), lambda p, h: (F.length(p) + F.length(h)).cast("long"))
        # sizes[i]: from the end of match i - 2 to the end of piece i, less the piece: the gap before match i and the match before it
        ends = lambda st: F.zip_with(st, sizes, lambda a, b: a + b)
        span = lambda h, s: F.struct(s.alias("start"), F.lit(place).alias("place"), (s + F.length(h)).alias("stop"), F.lit(kind).alias("kind"))
        return F.zip_with(hits, ends(_starts(sizes)), span)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    all_ = _bind(hits, lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(none))
    return F.filter(all_, keep) if keep else all_


def _scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and weak spans of every text."""
    text = text_of()
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_ = lambda spans: _bind(values, lambda v: F.filter(spans, lambda s, i: F.length(F.get(v, i)) >= ASSIGN_LEAST))
    # a run that looks random has capitals, small letters and digits, and no colon as an endpoint has
    mixed = lambda s: F.substring(text, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")).rlike(r"^(?=[^:]*[a-z])(?=[^:]*[A-Z])(?=[^:]*[0-9])[^:]*$")
    base = [long_(_found(text, "assign", ASSIGN)), _found(text, "access", ACCESS), _found(text, "hex", HEX)]
    weak = [_found(text, "identifier", IDENTIFIER), _found(text, "random", RUNS, mixed), _found(text, "endpoint", ENDPOINT)]
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *[x.alias(k) for k, x in zip(KINDS, base + weak, strict=True)]
    )


def _linked(scanned: DataFrame, scope: int) -> DataFrame:
    """row and the weak spans that stand with complementary parts and overlap no base span: linked."""
    weak = [k for k in KINDS if k not in BASE]
    roles = lambda names: F.size(F.concat(*[F.col(k) for k in names])) > 0
    with_role = {r: [k for k, x in KINDS.items() if x == r] for r in NEEDS}
    some = F.lit(False)
    for role, needs in NEEDS.items():
        own = [k for k in with_role[role] if k in weak]
        some = some | (roles(own) & roles([k for n in needs for k in with_role[n]]))
    parts = (
        scanned.where(some)
        .select("row", F.explode(F.concat(*[F.col(k) for k in KINDS])).alias("span"))
        .select("row", "span.*", F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("span.kind")].alias("role"))
    )
    cell = lambda at: F.floor(at / scope).cast("long")
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(k).alias("at")) for k in ("start", "stop")])).alias("to")
    ends = parts.select("row", "role", both).select("row", "role", "to.end", "to.at", cell(F.col("to.at")).alias("cell"))
    ends = ends.groupBy("row", "end", "cell").agg(*[f(F.when(F.col("role") == r, F.col("at"))).alias(f"{n}_{r}") for r in NEEDS for n, f in (("first", F.min), ("last", F.max))])
    # the stop of a part before lies in (start - scope, start), the start of one after in (stop, stop + scope): two cells each,
    # of which one has the nearest as its first and the other as its last
    ask = lambda end, low, high: [F.struct(F.lit(end).alias("end"), c.alias("cell"), low.alias("low"), high.alias("high")) for c in (cell(low), cell(high))]
    start, stop = F.col("start"), F.col("stop")
    asks = parts.where(F.col("kind").isin(weak)).withColumn("ask", F.explode(F.array(*ask("stop", start - scope, start), *ask("start", stop, stop + scope)))).select("row", "role", "kind", "start", "place", "stop", "ask.*")
    near = F.lit(False)
    for role, needs in NEEDS.items():
        within = [F.coalesce(F.col(f"{n}_{other}").between(F.col("low"), F.col("high")), F.lit(False)) for other in needs for n in ("first", "last")]
        near = near | ((F.col("role") == role) & F.array_contains(F.array(*within), True))
    found = asks.join(ends, ["row", "end", "cell"]).where(near).select("row", "start", "place", "stop", "kind").distinct()
    # of these, the ones that overlap a base span: both meet in the cells that they cover
    cells = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))).alias("cell")
    base = parts.where(F.col("kind").isin(*BASE)).select("row", F.col("start").alias("from"), F.col("stop").alias("to"), cells)
    over = found.select("row", "start", "place", "stop", cells).join(base, ["row", "cell"]).where((F.col("from") < F.col("stop")) & (F.col("start") < F.col("to")))
    found = found.join(over.select("row", "start", "place").distinct(), ["row", "start", "place"], "left_anti")
    return found.groupBy("row").agg(F.collect_list(F.struct("start", "place", "stop", "kind")).alias("linked"))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row of docs: doc_id, the spans of each base kind, and linked, the weak spans that are reported.

    scope: how many code points may stand between two parts of one credential, which do not overlap. A weak span that overlaps a base span is not
    reported beside it. A null text is empty and has no spans. Rows with equal or null doc_id stay rows of their own.
    An empty table gives no rows. Other columns of docs are not read.
    """
    scanned = settle(_scanned(docs), "spans")
    out = scanned.join(_linked(scanned, scope), "row", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<struct<start:bigint,place:int,stop:bigint,kind:string>>")))
    return out.select("doc_id", *BASE, "linked")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, by start and kind, joined by commas."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
