"""Personal data by bootstrapped contextual extraction, in Spark expressions only.

Fixed expressions find base spans: e-mail and IP addresses, card and phone
numbers.  These seed a graph between lexical patterns (the words beside an
identifier) and instances (tokens that look like identifiers).  Spark scores the
graph in rounds: a pattern by the share of its instances that are believed, an
instance by the patterns it occurs in.  Patterns of high confidence then mark
the unseen identifiers that stand in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselark.llm.shared import cut

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, written so that Java tries no start twice: possessive
#: quantifiers where giving back can't help, and a look behind where an earlier
#: start of the same run has failed already.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What could be an identifier: a token with a digit or an at sign, and the digit groups that go on from it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(]?[0-9][0-9().-]*+)*+"
#: Characters of context that are looked at on either side.
CONTEXT = 64
#: Results that are collected in one array before it is put to the others, and characters in a piece of a text.
PIECE, PIECE_CHARACTERS = 128, 4096
#: Rounds of scoring; evidence and confidence that a pattern needs.
ROUNDS, LEAST_SEEDS, LEAST_SHARE = 3, 5, 0.8


def scanned(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """What ``step`` makes of each item, in order; it gets the state before and returns the state after and a ``kind``.

    Results are collected in pieces of PIECE, as appending copies an array: the
    work grows with the number of items, not with its square.
    """
    names = list(state)

    def with_done(values, done: Column) -> Column:
        return F.struct(*[values[n].alias(n) for n in names], done.alias("done"))

    def one(acc: Column, item: Column) -> Column:
        after, made = step(acc, item)
        return with_done(after, F.array_append(acc["done"], made))

    def piece(acc: Column, part: Column) -> Column:
        empty = with_done(acc, F.array().cast(f"array<{kind}>"))
        return F.aggregate(part, empty, one, lambda r: with_done(r, F.array_append(acc["done"], r["done"])))

    def whole(bound: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(bound) - 1) / PIECE)).cast("int"))
        start = with_done(state, F.array().cast(f"array<array<{kind}>>"))
        return F.aggregate(places, start, lambda acc, k: piece(acc, F.slice(bound, k * PIECE + 1, F.lit(PIECE))), lambda acc: F.flatten(acc["done"]))

    return bind(items, whole)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as a lambda computes what it takes from outside at each call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(text: Column) -> Column:
    return F.substring(text, 1, CONTEXT)


def _last(text: Column) -> Column:
    """One character more than the context: it tells a word that is cut from one that begins there."""
    return F.substring(text, -(CONTEXT + 1), CONTEXT + 1)


def _spans(text: Column, expression: str, kind: str) -> Column:
    """Matches as structs (kind, start, end, match, before, after); starts and ends count code points.

    The text between the matches gives their places, so this takes one pass of
    splitting and one of extracting.  before and after are up to CONTEXT
    characters of the text around a match, other matches included; where before
    is cut inside a word, that word is left out.
    """
    between = F.split(text, expression, -1)
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    # zipped, not indexed: a lambda would split the text again for every match
    gaps = F.zip_with(between, F.slice(between, F.lit(2), F.size(between)), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g["before"].alias("before"), g["after"].alias("after")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    span_kind = "struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>"

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        left = _last(F.concat(acc["tail"], _last(x["before"])))
        before = F.when(F.length(left) > CONTEXT, F.regexp_replace(left, r"^\S+\s", " ")).otherwise(left)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("m"), before.alias("before"), _first(x["after"]).alias("after"))
        return {"at": end, "tail": _last(F.concat(left, _last(x["m"])))}, span

    def back(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        after = _first(F.concat(x["after"], acc["head"]))
        span = F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "m", "before")], after.alias("after"))
        return {"head": _first(F.concat(_first(x["m"]), after))}, span

    forth = scanned(pairs, {"at": F.lit(0).cast("long"), "tail": F.lit("")}, step, span_kind)
    return F.reverse(scanned(F.reverse(forth), {"head": F.lit("")}, back, span_kind))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(match)), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str):
    return lambda span: _passes(span["m"], kind)


def _passes(m: Column, kind: str) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind as listed."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>>")
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?+[0-9]){13}"), "phone": text.contains("+")}
    parts = []
    for kind in KINDS:
        found = F.filter(_spans(text, EXPRESSIONS[kind], kind), _valid(kind))
        parts.append(F.when(hint[kind], found).otherwise(none))
    return F.concat(*parts)


def _in_order(spans: Column) -> Column:
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span: one scan with the furthest end before, one back with the next start."""
    none = F.lit(None).cast("struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>")
    marks = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), b["end"].alias("end"), none.alias("span")))
    own = F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), s.alias("span")))
    kind = "struct<start:bigint,end:bigint,span:struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>,hit:boolean>"

    def seen(x: Column, hit: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["span"].alias("span"), hit.alias("hit"))

    def forth(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        return {"reach": F.when(x["span"].isNull(), F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"])}, seen(x, acc["reach"] > x["start"])

    def back(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        return {"next": F.when(x["span"].isNull(), x["start"]).otherwise(acc["next"])}, seen(x, x["hit"] | (acc["next"] < x["end"]))

    ahead = scanned(F.array_sort(F.concat(marks, own)), {"reach": F.lit(0).cast("long")}, forth, kind)
    both = scanned(F.reverse(ahead), {"next": F.lit((1 << 63) - 1)}, back, kind)
    left = F.transform(F.filter(both, lambda x: x["span"].isNotNull() & ~x["hit"]), lambda x: x["span"])
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(F.reverse(left))


def _words_beside(span: Column) -> Column:
    """Patterns of a span: the two words before it, the word before and after it (lower case)."""
    before = F.filter(F.split(F.lower(F.regexp_replace(span["before"], r"[,;:!?\"'()\[\]]", " ")), r"\s+"), lambda w: w != "")
    after = F.filter(F.split(F.lower(F.regexp_replace(span["after"], r"[,;:!?\"'()\[\]]", " ")), r"\s+"), lambda w: w != "")
    one, two, nxt = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.try_element_at(after, F.lit(1))
    two_words = F.when(two.isNotNull(), F.concat(F.lit("<< "), two, F.lit(" "), one))
    frame = F.when(one.isNotNull() & nxt.isNotNull(), F.concat(F.lit("<> "), one, F.lit(" _ "), nxt))
    return F.array_compact(F.array(two_words, frame))


def _shape(token: Column) -> Column:
    """What kind of identifier a token looks like: an address, a number of five digits or more, or a mixture."""
    number = ~token.rlike(r"\p{L}") & (F.length(_digits(token)) >= 5)
    return F.when(token.contains("@"), "address").when(number, "number").otherwise("mixture")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns to trust.

    ``edges`` has pattern, instance, seed (the base kind, or null) and shape.
    In each round a pattern's confidence for a kind is the belief in its
    instances over their number, and an unseen instance is believed as far as
    its best pattern, if it looks like a seed of that kind.  Instances are
    counted once, however often they occur.  There must be one round at least.
    """
    if rounds < 1:
        raise ValueError("scoring takes one round at least")
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min("shape").alias("shape")))
    size = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    seeds = edges.where("seed is not null")
    support = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    open_edges = cut(edges.join(support.select("pattern").distinct(), "pattern"))
    belief = seeds.select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    shapes = seeds.select(F.col("seed").alias("kind"), "shape").distinct()
    scores = None
    for _ in range(rounds):
        held = open_edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("held"))
        scores = cut(held.join(support, ["pattern", "kind"]).join(size, "pattern").select("pattern", "kind", (F.col("held") / F.col("instances")).alias("confidence")))
        if scores.isEmpty():
            break
        unseen = open_edges.where("seed is null").join(scores, "pattern").join(shapes, ["kind", "shape"])
        unseen = unseen.groupBy("instance", "kind").agg((F.max("confidence") * 0.9).alias("belief"))
        belief = cut(seeds.select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct().unionByName(unseen))
    return scores.where(F.col("confidence") >= least_share)


def _digest(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Spans of personal data in each whole text.

    Returns id_col, text_digest (tells texts of one id apart), base and spans:
    arrays of structs (kind, start, end) in code points, end exclusive; spans
    holds the base ones and those that trusted patterns add.  Base matches are
    leftmost and do not overlap within a kind; matches that fail their test are
    dropped.  A null text counts as empty.  A text is read whole, in time that
    grows with its length and the number of its matches.  Null ids and repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,m:string,before:string,after:string>>")
    candidates = F.when(F.col("text").rlike("[0-9@]"), _spans(F.col("text"), CANDIDATE, "")).otherwise(none)
    rows = own.select("id", _digest(F.col("text")).alias("digest"), base_spans(F.col("text")).alias("base"), candidates.alias("candidates"))
    rows = cut(rows)
    some = rows.where("size(base) > 0 or size(candidates) > 0").dropDuplicates(["id", "digest"])
    seeds = some.select(F.explode("base").alias("s")).select(F.explode(_words_beside(F.col("s"))).alias("pattern"), F.col("s.m").alias("instance"), F.col("s.kind").alias("seed"))
    core = r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$"
    free = some.select("id", "digest", F.explode(_apart(F.col("candidates"), F.col("base"))).alias("s"))
    free = free.select("id", "digest", "s", F.regexp_replace("s.m", core, "").alias("instance"), F.explode(_words_beside(F.col("s"))).alias("pattern"))
    edges = seeds.unionByName(free.select("pattern", "instance", F.lit(None).cast("string").alias("seed"))).withColumn("shape", _shape(F.col("instance")))
    trusted = score_patterns(edges, rounds, least_seeds, least_share)
    shapes = seeds.select(F.col("seed").alias("kind"), _shape(F.col("instance")).alias("shape")).distinct()
    lead = F.length("s.m") - F.length(F.regexp_replace("s.m", r"^[\"'(\[<]+", ""))
    hits = free.join(trusted, "pattern").withColumn("shape", _shape(F.col("instance"))).join(shapes, ["kind", "shape"])
    best = F.row_number().over(Window.partitionBy("id", "digest", "s.start").orderBy(F.desc("confidence"), "kind"))
    start = F.col("s.start") + lead
    hits = hits.withColumn("n", best).where("n = 1").select("id", "digest", F.struct("kind", start.alias("start"), (start + F.length("instance")).alias("end")).alias("span"))
    added = hits.groupBy(F.col("id").alias("other"), F.col("digest").alias("d")).agg(F.collect_set("span").alias("added"))
    out = rows.join(added, F.col("id").eqNullSafe(F.col("other")) & (F.col("digest") == F.col("d")), "left")
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("text_digest"), plain.alias("base"), F.concat(plain, F.coalesce("added", nothing)).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_in_order(F.col("base")), 256).alias("base_sha256"), _in_order(F.col("spans")).alias("spans"))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in pieces; only the pieces that are touched are read."""
    size = PIECE_CHARACTERS
    first, last = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = F.substring(piece(first), (start % size + 1).cast("int"), (end - start).cast("int"))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    over = F.concat(F.substring(piece(first), (start % size + 1).cast("int"), F.lit(size)), between, F.substring(piece(last), F.lit(1), (end % size).cast("int")))
    return F.when(first == last, within).otherwise(over)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, kind) replaced by <kind>; overlapping spans leave the mark of the first."""
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"))))
    zero = F.lit(0).cast("long")

    def of(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
            new = F.concat(_cut(pieces, acc["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">"))
            return {"at": F.greatest(acc["at"], -s["far"])}, F.when(s["start"] < acc["at"], F.lit("")).otherwise(new)

        last = F.coalesce(F.array_max(F.transform(spans, lambda s: -s["far"])), zero)
        return F.concat(F.array_join(scanned(spans, {"at": zero}, step, "string"), ""), _cut(pieces, last, F.length(text).cast("long")))

    return bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE_CHARACTERS}}}"), F.lit(0)), of)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` replaced by <kind> in its text.

    Overlapping spans leave the mark of the first.  Rows, their order of
    columns and all other columns stay, whatever their names; null texts and
    texts without spans stay as they are.  Rows with a null id are masked like
    others, repeated rows one by one; an empty table gives no rows.  The work on
    a text grows with its length and the number of its spans.
    """
    text = F.col(text_col)
    spare = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the table
    other, digest, spans = (spare + n for n in ("id", "digest", "spans"))
    marks = found.where("size(spans) > 0").select(F.col(id_col).alias(other), F.col("text_digest").alias(digest), F.col("spans").alias(spans)).dropDuplicates([other, digest])
    possible = F.coalesce(text.rlike("[0-9@]"), F.lit(False))  # any span holds one of these
    some = docs.where(possible).join(marks, F.col(id_col).eqNullSafe(F.col(other)) & (_digest(text) == F.col(digest)), "left")
    new = F.when(F.col(spans).isNotNull(), masked(text, F.col(spans))).otherwise(text)
    some = some.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~possible).unionByName(some)
