"""Personal data: patterns of known form, and contexts learned from them, with DataFrame functions only.

Regular expressions and checks find seed entities. Around identifier-like tokens (words with a digit
or an at sign, number groups that follow each other as one) lexical patterns are induced: the word or
two before the token, however long, or before the list that it stands in. Patterns and instances form
a graph. A round scores each pattern by the scores of its distinct instances, and each instance by
the patterns that it fills; an instance that patterns make nearly sure counts as a seed in the next
round, and so supports patterns that no expression's match ever fills. Sure patterns with enough
such instances mark what no expression knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing, small_side

KINDS = ("email", "ip", "card", "phone")

_WORD = r"A-Za-z0-9._%+-"
#: The expressions with possessive repeats, and starts only where a run of their first characters
#: starts (or a match has just ended): the same leftmost matches, found in linear time and without
#: recursion on very long runs.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign, from the start of a word.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:(?<=[0-9])\x20[0-9]++(?![^\x20\x09-\x0D]))*+"
#: Of learned spans, unless ``least_length`` says another: shorter tokens are mostly years, counts and ordinals.
LEAST_LENGTH = 6
#: Characters that do not belong to an identifier at its ends.
_EDGES = r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}@]+$"

#: Rounds at least; more follow as long as patterns become sure.
ROUNDS = 3
#: A pattern needs this many different seed instances, and this score.
LEAST_SEEDS, SURE = 5, 0.9
#: An instance with this score counts as a seed.
PROMOTED = 0.8


def located(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end, m, gap): code points, end exclusive; gap is the text before.

    Gaps and matches alternate, so running sums of their lengths give positions. The sums go over
    chunks of about the root of the number of matches: adding to an array copies it, and so even a
    text of very many matches copies little.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    spans = "array<struct<start:int,end:int,m:string,gap:string>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("m"), p["g"].alias("gap")))
        return F.when(p["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out")))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def whole(pairs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / width).cast("int")), lambda k: F.slice(pairs, k * width + 1, width))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))

    # as a lambda's argument the matches are found once, not once a chunk
    return F.transform(F.array(pairs), whole)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether 14 to 19 digits have a valid check sum; doubled digits count from the right."""
    reverse = F.split(F.reverse(_digits(m)), "")
    total = F.aggregate(
        F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.length(_digits(m)).between(14, 19) & (total % 10 == 0)


def _checks(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (missing(p.try_cast("int"), 0) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _checked(hits: Column, kind_no: int) -> Column:
    kind = KINDS[kind_no]
    sound = F.filter(hits, lambda s: _checks(kind, s["m"]))
    return F.transform(sound, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """Checked matches of all kinds: array of (start, order, kind, end) in order of start, then kind."""
    needs = {"email": text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    spans = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
    found = []
    for k, kind in enumerate(KINDS):
        found.append(F.when(needs[kind], _checked(located(text, PATTERNS[kind]), k).cast(spans)).otherwise(F.array().cast(spans)))
    return F.array_sort(F.concat(*found))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _candidates(text: Column) -> Column:
    """Identifier-like tokens: (start, end, token, left), without marks at their ends.

    ``left`` is the word or two in the text between the token before and this one, in lower case;
    empty if there is none.
    """
    first = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?"

    def shape(s: Column) -> Column:
        front = F.length(F.regexp_extract(s["m"], r"^[^\p{L}\p{N}+@]*", 0))
        core = F.regexp_replace(s["m"], _EDGES, "")
        left = F.reverse(F.regexp_extract(F.reverse(s["gap"]), first, 0))
        left = F.trim(F.regexp_replace(F.lower(left), r"[\x20\x09-\x0D]+", " "))
        return F.struct((s["start"] + front).alias("start"), (s["start"] + front + F.length(core)).alias("end"), core.alias("token"), left.alias("left"))

    rows = "array<struct<start:int,end:int,token:string,left:string>>"
    return F.when(text.rlike("[0-9@]"), F.transform(located(text, CANDIDATE), shape).cast(rows)).otherwise(F.array().cast(rows))


def learned_patterns(seen: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, sure: float = SURE, promoted: float = PROMOTED) -> tuple[DataFrame, DataFrame]:
    """pattern, token, kind (null unless a seed) -> sure patterns (pattern, kind, confidence), and instances (token, kind, score).

    Edges are distinct pairs of pattern and token, so frequent repeats weigh nothing. All edges take
    part in all rounds, and rounds go on until no pattern is new among the sure ones. Sums by pattern or token are partial first, and scores come back by a
    broadcast while they are few, so a pattern that very many tokens fill is no task's load.
    """
    edges = cut(seen.groupBy("pattern", "token").agg(F.max("kind").alias("seed")))
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"))
    seeds = small_side(cut(edges.where("seed is not null").groupBy("token").agg(F.max("seed").alias("kind"), F.lit(1.0).alias("score"))))
    scores, good, known, done = seeds, None, -1, 0
    while True:
        own = edges.select("pattern", "token").join(scores, "token")
        by_kind = own.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum((F.col("score") >= promoted).cast("long")).alias("support"))
        best = by_kind.groupBy("pattern").agg(F.max_by(F.struct("kind", "score", "support"), F.struct("score", "support", "kind")).alias("b")).select("pattern", "b.*")
        # one instance more, without score, keeps rare patterns low
        patterns = cut(best.join(degree, "pattern").select("pattern", "kind", (F.col("score") / (F.col("degree") + 0.1)).alias("confidence"), "support"))
        good = cut(patterns.where((F.col("confidence") >= sure) & (F.col("support") >= least_seeds)).select("pattern", "kind", "confidence"))
        before, known, done = known, good.count(), done + 1
        telling = small_side(cut(patterns.where(F.col("confidence") >= 0.5)))
        back = edges.where("seed is null").join(telling, "pattern")
        sound = (F.col("confidence") >= sure) & (F.col("support") >= least_seeds)
        # a token of sure patterns is nearly sure itself; others vouch in proportion
        trust = F.when(sound, F.lit(0.95)).otherwise(F.col("confidence") / 2)
        mine = back.groupBy("token", "kind").agg((1 - F.exp(F.sum(F.log(1 - trust)))).alias("score"))
        mine = mine.groupBy("token").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("token", "b.*")
        mine = mine.join(seeds.select("token"), "token", "left_anti")
        scores = small_side(cut(seeds.union(mine.select("token", "kind", F.when(F.col("score") >= promoted, 1.0).otherwise(F.col("score")).alias("score")))))
        if done >= rounds and known <= before:
            return good, scores


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, **options) -> DataFrame:
    """One row per document row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    ``base_sha256`` digests the spans of the four known forms, ``spans`` joins these and the ones that
    learned contexts add (with the kind of their context's seeds), each as kind:start:end in code
    points. A learned span never overlaps a known one and has ``least_length`` characters or more. A token
    of a list, with no word between it and the token before, has the list's context; one at the start
    of the text has that as its context. Null counts as empty; repeated rows are marked alike; an empty
    table gives no rows; other columns are ignored.
    """
    text = missing(F.col(text_col), "")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), _candidates(text).alias("tokens"))
    rows = cut(rows)
    # a token is a seed of the kind whose span it overlaps: of the spans that start before its end, the one that reaches furthest
    event = "array<struct<pos:int,what:int,start:int,end:int,token:string,left:string,kind:string>>"
    none = F.lit(None).cast("string")
    tokens = F.transform("tokens", lambda t: F.struct(t["end"].alias("pos"), F.lit(0).alias("what"), t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), t["left"].alias("left"), none.alias("kind"))).cast(event)
    spans = F.transform("base", lambda b: F.struct(b["start"].alias("pos"), F.lit(1).alias("what"), b["start"].alias("start"), b["end"].alias("end"), none.alias("token"), none.alias("left"), b["kind"].alias("kind"))).cast(event)
    events = rows.where(F.size("tokens") > 0).select("row", F.inline(F.concat(tokens, spans)))
    before = Window.partitionBy("row").orderBy("pos", "what", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach, left = F.max(F.when(F.col("what") == 1, F.struct("end", "kind"))).over(before), F.last(F.nullif(F.col("left"), F.lit("")), ignorenulls=True).over(before)
    token = events.select("*", reach.alias("reach"), left.alias("context")).where((F.col("what") == 0) & (F.length("token") >= least_length))
    token = cut(token.select("row", "start", "end", F.lower("token").alias("token"), missing(F.col("context"), "^").alias("left"), F.when(F.col("reach.end") > F.col("start"), F.col("reach.kind")).alias("kind")))
    wide = token.select("row", "start", "end", "token", "kind", F.explode(F.array_distinct(F.array(F.element_at(F.split("left", " "), -1), "left"))).alias("pattern"))
    good, _ = learned_patterns(wide, **options)
    added = wide.where("kind is null").select("row", "start", "end", "pattern").join(small_side(cut(good)), "pattern")
    added = added.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    added = added.select("row", F.struct("start", number.alias("kind_no"), "kind", "end").alias("s")).groupBy("row").agg(F.collect_list("s").alias("more"))
    added = small_side(cut(added.withColumnRenamed("row", "own")))
    out = rows.join(added, rows["row"] == added["own"], "left")
    more = F.coalesce("more", F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>"))
    every = F.array_sort(F.concat("base", more))
    counts = [_count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"), F.size(more).cast("long").alias("n_added"))
