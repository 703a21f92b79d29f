"""Operator 4: personal data by bootstrapped contextual extraction.

Strict expressions find base entities (email, ip, card, phone) with their offsets; each is an instance
of its kind. What they leave of the text is searched for pieces with a digit or ``@``, and each piece
is an instance without a kind; digit groups one space or slash apart are one instance as long as the
groups so far are no whole number (fewer than 10 digits, or groups of a card). Words to the left and to
the right are lexical patterns, told apart by whether the instance holds ``@``; instances with neither
letter nor line break between them share their words. Over rounds, patterns are scored on the
pattern-instance graph by the share of their distinct instances that belong to a kind, and instances
without a kind take one from patterns of high confidence if their shape allows; those instances then
count in the next round. Occurrences of such patterns become further spans. Base spans always stay.
Everything is DataFrame functions; texts are read once. Rounds end when no pattern changes, or after
``rounds``.

Work is linear in a text and its matches: folds run over blocks of ``BLOCK`` elements, so that no long
array is copied at each step, and characters are taken from ``CHUNK``-sized chunks of the text, so that
no offset is counted from the start of the text.

The expressions give the leftmost, non-overlapping matches of the plain forms in ``PLAIN`` in linear
time: runs are possessive and matches start only where a run starts (or a match ended).

Defined results: null text is empty (no spans, digest of the empty string); repeated rows each give
a row; null doc_ids stay null; an empty table gives no rows; extra columns are ignored by
``extract`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: The plain forms, as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for each character of a base span; a separator of pieces like white space and some signs.
MASK = "\ue000"
SEPARATORS = r"""\x20\x09-\x0D,;|/<>="'\[\]{}""" + MASK
PIECE = rf"(?<![^{SEPARATORS}:])(?:[A-Fa-f]{{1,4}}:){{0,7}}+[^{SEPARATORS}:0-9@]*+[0-9@][^{SEPARATORS}]*+"
BLOCK, CHUNK = 128, 512


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, state: Column, step, made: str) -> Column:
    """Outputs of a fold: ``step(state, item)`` gives (next state, array of outputs of type ``made``).
    Outputs are gathered by block and flattened at the end."""
    none, some = F.expr(f"cast(array() as array<{made}>)"), F.expr(f"cast(array() as array<array<{made}>>)")

    def one(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def of_block(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _once(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def over(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / F.lit(BLOCK)).cast("int")
        blocks = F.when(F.size(all_items) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(all_items, i * BLOCK + 1, BLOCK)))
        return F.when(F.size(all_items) > 0, F.aggregate(blocks, F.struct(state.alias("state"), some.alias("out")), of_block, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return _once(items, over)


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def taken(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from offset ``start`` of a text in chunks."""
    first = F.floor(start / F.lit(CHUNK))
    many = F.floor((start + length - 1) / F.lit(CHUNK)) - first + 1
    own = F.array_join(F.slice(chunks, (first + 1).cast("int"), F.greatest(many, F.lit(0)).cast("int")), "")
    return F.when(length > 0, F.substring(own, (start - first * CHUNK + 1).cast("int"), length.cast("int"))).otherwise("")


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Matches of ``pattern`` with offsets in code points, and the text to the left of each if asked for:
    the pieces between matches and the matches add up to the text. With ``context`` what follows the last
    match comes as an element without ``x``."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, x: F.struct(g.alias("g"), x.alias("x")))

    def step(pos: Column, e: Column) -> tuple[Column, Column]:
        start = pos + F.length(e["g"])
        end = start + F.coalesce(F.length(e["x"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), e["x"].alias("x"), (e["g"] if context else F.lit(None).cast("string")).alias("left"))
        return end, F.array(one)

    found = scan(both, F.lit(0).cast("bigint"), step, "struct<start:bigint,end:bigint,x:string,left:string>")
    return found if context else F.filter(found, lambda m: m["x"].isNotNull())


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, d: Column) -> Column:
        n = d.cast("int") * (1 + acc["i"] % 2)
        return F.struct((acc["sum"] + n - F.when(n > 9, 9).otherwise(0)).alias("sum"), (acc["i"] + 1).alias("i"))

    ones = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(ones, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), step, lambda acc: acc["sum"] % 10 == 0)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(12, 19) & luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, x>> of a text's base entities, in the order of the contract."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"), "phone": text.contains("+")}
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,x:string>>)")

    def part(rank: int, kind: str) -> Column:
        kept = F.filter(matches(text, LINEAR[kind]), lambda m: valid(kind, m["x"]))
        shaped = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["x"].alias("x")))
        return F.when(hint[kind], shaped).otherwise(none)

    return F.array_sort(F.concat(*[part(i, k) for i, k in enumerate(KINDS)]))


def _left(gap: Column) -> Column:
    """Patterns of the one and two words that end a gap, and of the last word with the signs after it."""
    words = F.filter(F.split(F.lower(gap), r"[^\p{L}]+"), lambda w: w != "")
    near, far = F.try_element_at(words, F.lit(-1)), F.try_element_at(words, F.lit(-2))
    forms = F.array(F.concat(F.lit("2 "), far, F.lit(" "), near), F.concat(F.lit("1 "), near), F.concat(F.lit("p "), near, F.lit(" "), F.regexp_extract(gap, r"([^\p{L}\s]*)\s*$", 1)))
    return F.filter(forms, lambda f: f.isNotNull())


def _right(gap: Column) -> Column:
    """Patterns of the one and two words that begin a gap."""
    two = F.filter(F.split(F.lower(F.regexp_extract(gap, r"^[^\p{L}]*+\p{L}++(?:[^\p{L}]++\p{L}++)?", 0)), r"[^\p{L}]+"), lambda w: w != "")
    return F.filter(F.array(F.concat(F.lit("r "), F.try_element_at(two, F.lit(1))), F.concat(F.lit("s "), F.try_element_at(two, F.lit(1)), F.lit(" "), F.try_element_at(two, F.lit(2)))), lambda f: f.isNotNull())


def masked(text: Column, base: Column) -> Column:
    """The text with every character of a base span replaced by ``MASK``."""
    text = F.replace(text, F.lit(MASK), F.lit("\ue001"))

    def over(chunks: Column) -> Column:
        def step(pos: Column, s: Column) -> tuple[Column, Column]:
            start, end = F.greatest(s["start"], pos), F.greatest(s["end"], pos)
            return end, F.array(taken(chunks, pos, start - pos), F.repeat(F.lit(MASK), (end - start).cast("int")))

        last = F.struct(F.length(text).cast("bigint").alias("start"), F.lit(9).alias("rank"), F.length(text).cast("bigint").alias("end"), F.lit("").alias("kind"), F.lit("").alias("x"))
        return F.array_join(scan(F.concat(base, F.array(last)), F.lit(0).cast("bigint"), step, "string"), "")

    return F.when(F.size(base) == 0, text).otherwise(_once(chunked(text), over))


NO_FORMS = "cast(array() as array<string>)"
FORMS = "array<string>"
UNIT = "start:bigint,end:bigint,x:string,forms:array<string>,open:boolean"


def pieces(hidden: Column) -> Column:
    """Pieces and masked stretches of a masked text with the patterns of the words around them:
    array<struct<start, end, x, gap, forms>>."""
    found = matches(hidden, f"{MASK}++|{PIECE}", context=True)
    bridge = lambda gap: ~gap.rlike(r"[\p{L}\n]")

    def onward(forms: Column, m: Column) -> tuple[Column, Column]:
        now = F.when(bridge(m["left"]), forms).otherwise(_left(m["left"]))
        return now, F.array(now)

    def backward(acc: Column, m: Column) -> tuple[Column, Column]:
        # the element after the last match only hands on its gap
        now = F.when(acc["gap"].isNull() | bridge(acc["gap"]), acc["forms"]).otherwise(_right(acc["gap"]))
        return F.struct(m["left"].alias("gap"), now.alias("forms")), F.array(now)

    def around(ms: Column) -> Column:
        left = scan(ms, F.expr(NO_FORMS), onward, FORMS)
        right = F.reverse(scan(F.reverse(ms), F.struct(F.lit(None).cast("string").alias("gap"), F.expr(NO_FORMS).alias("forms")), backward, FORMS))
        both = F.zip_with(left, right, lambda a, b: F.concat(a, b))
        every = F.zip_with(ms, both, lambda m, f: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["x"].alias("x"), m["left"].alias("gap"), f.alias("forms")))
        return F.filter(every, lambda m: m["x"].isNotNull())

    return _once(found, around)


def units(found: Column) -> Column:
    """Pieces with digit groups of one number joined: array<struct<start, end, x, forms, open>>."""
    digits = lambda x: F.length(_digits(x))

    def step(cur: Column, m: Column) -> tuple[Column, Column]:
        a, b = digits(cur["x"]), digits(m["x"])
        card = (cur["x"].rlike("^[0-9]{4}(?: [0-9]{4})+$") & m["x"].rlike(r"^[0-9]{1,4}[.!?:*)]*$")) | (cur["x"].rlike("^[0-9]{4} [0-9]{6}$") & m["x"].rlike(r"^[0-9]{5}[.!?:*)]*$"))
        fits = (a + b <= 19) & (b < 9) & ((a < 7) | (b < 7)) & ((a < 10) | card)
        joins = F.coalesce(cur["open"] & m["gap"].isin(" ", "/") & m["x"].rlike(r"^\(?[0-9][0-9().-]*[.!?:*)]*$") & fits, F.lit(False))
        opens = m["x"].rlike(r"^[+(]{0,2}[0-9](?:[0-9().-]*[0-9)])?$")
        one = F.struct(
            F.when(joins, cur["start"]).otherwise(m["start"]).alias("start"), m["end"].alias("end"), F.when(joins, F.concat(cur["x"], m["gap"], m["x"])).otherwise(m["x"]).alias("x"),
            F.when(joins, cur["forms"]).otherwise(m["forms"]).alias("forms"), opens.alias("open"),
        )
        return one, F.when(joins | cur["x"].isNull(), F.expr(f"cast(array() as array<struct<{UNIT}>>)")).otherwise(F.array(cur))

    # one more element, which joins nothing, gives out the last unit
    end = F.expr("named_struct('start', bigint(0), 'end', bigint(0), 'x', '', 'gap', '', 'forms', cast(array() as array<string>))")
    return scan(F.concat(found, F.array(end)), F.expr(f"cast(null as struct<{UNIT}>)"), step, f"struct<{UNIT}>")


def instances(base: Column, found: Column) -> Column:
    """array<struct<start, end, x, kind, patterns>>: base entities with their kind and other identifier-like units with
    none, both with their patterns. ``found`` holds ``pieces`` of the masked text."""
    typed = lambda x, forms: F.transform(forms, lambda f: F.concat(F.when(x.contains("@"), F.lit("@")).otherwise(F.lit("#")), f))
    is_mask = lambda m: m["x"].startswith(MASK)

    def stretch(acc: Column, b: Column) -> tuple[Column, Column]:
        """Base spans that touch make one masked stretch: number the stretches."""
        now = acc["run"] + F.when(b["start"] > acc["end"], 1).otherwise(0)
        return F.struct(F.greatest(acc["end"], b["end"]).alias("end"), now.alias("run")), F.array(now)

    def known(runs: Column) -> Column:
        first = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).alias("run"))
        return F.zip_with(base, scan(base, first, stretch, "int"), lambda b, run: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["x"].alias("x"), b["kind"].alias("kind"), typed(b["x"], F.element_at(runs, run)["forms"]).alias("patterns")))

    def shaped(u: Column) -> Column:
        lead = F.length(F.regexp_extract(u["x"], r"^[^\p{L}0-9+(]*", 0))
        tail = F.length(F.regexp_extract(u["x"], r"[^\p{L}0-9)]*+$", 0))
        x = F.trim(F.regexp_replace(F.regexp_replace(u["x"], r"^[^\p{L}0-9+(]*", ""), r"[^\p{L}0-9)]*+$", ""))
        return F.struct((u["start"] + lead).alias("start"), F.greatest(u["end"] - tail, u["start"] + lead).alias("end"), x.alias("x"), F.lit(None).cast("string").alias("kind"), typed(x, u["forms"]).alias("patterns"))

    rest = F.filter(F.transform(F.filter(units(found), lambda u: ~is_mask(u)), shaped), lambda o: o["end"] > o["start"])
    return F.concat(_once(F.filter(found, is_mask), known), rest)


def may_be(kind: Column, x: Column) -> Column:
    """Shapes looser than the base forms, by kind."""
    n = F.length(_digits(x))
    plain = ~x.rlike(r"\p{L}")
    return F.when(kind == "email", x.contains("@")).when(kind == "ip", x.rlike(r"^[0-9A-Fa-f]+(?:[.:-][0-9A-Fa-f]+){3,7}$")).when(kind == "card", plain & n.between(12, 19)).when(kind == "phone", plain & n.between(7, 15)).otherwise(False)


def learn(occurrences: DataFrame, rounds: int = 8, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """``(pattern, kind, conf)`` of high confidence, from ``occurrences(x, kind, patterns)``; at most
    ``rounds`` rounds, fewer where a round leaves all patterns as they were."""
    graph = cut(occurrences.select(F.explode("patterns").alias("pattern"), "x", "kind").groupBy("pattern", "x").agg(F.max("kind").alias("kind")), "pii-graph")
    weight = graph.select("pattern", "x", "kind", F.lit(1.0).alias("w")).where("kind is not null")
    size = graph.groupBy("pattern").agg(F.count("*").alias("n"))
    before = None
    for _ in range(rounds):
        mass = weight.groupBy("pattern", "kind").agg(F.sum("w").alias("w"), F.count("*").alias("seeds"))
        good = cut(mass.where(F.col("seeds") >= support).join(size, "pattern").select("pattern", "kind", (F.col("w") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= confidence), "pii-patterns")
        mark = good.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern", "kind", F.round("conf", 6)))).first()
        if mark == before:
            break
        before = mark
        fresh = graph.where("kind is null").drop("kind").join(good, "pattern").where(may_be(F.col("kind"), F.col("x")))
        fresh = fresh.groupBy("x", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf") * 0.999)))).alias("w"))
        best = fresh.groupBy("x").agg(F.max(F.struct("w", "kind")).alias("b")).select("x", "b.*").where(F.col("w") >= confidence)
        weight = graph.where("kind is not null").select("pattern", "x", "kind", F.lit(1.0).alias("w")).unionByName(graph.where("kind is null").drop("kind").join(best, "x").select("pattern", "x", "kind", "w"))
    return good


def extract(docs: DataFrame, rounds: int = 8, confidence: float = 0.8, support: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, base and spans (both array<struct<start, rank, end, kind>>); with ``keep``, ``row``
    holds the input's columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *kept).withColumn("base", base_spans(F.col("text")))
    first = first.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), pieces(masked(F.col("text"), F.col("base")))))
    first = first.withColumn("seen", F.when(F.col("found").isNotNull(), instances(F.col("base"), F.col("found"))))
    first = first.withColumn("base", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind"))))
    table = cut(first.drop("text", "found").withColumn("uid", F.monotonically_increasing_id()), "pii-rows")
    seen = table.where(F.size("seen") > 0).select("uid", F.explode("seen").alias("o")).select("uid", "o.*")
    good = learn(seen, rounds, confidence, support)
    near = seen.where("kind is null").drop("kind").select("uid", "start", "end", "x", F.explode("patterns").alias("pattern")).join(good, "pattern").where(may_be(F.col("kind"), F.col("x")))
    one = near.groupBy("uid", "start", "end").agg(F.max(F.struct("conf", "kind")).alias("b"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("b.kind")).cast("int") - 1
    more = one.groupBy("uid").agg(F.collect_list(F.struct("start", rank.alias("rank"), "end", F.col("b.kind").alias("kind"))).alias("more"))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return table.join(more, "uid", "left").select("doc_id", "base", every.alias("spans"), *(["row"] if keep else []))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The input with every span replaced by its kind in angle brackets; spans that overlap an earlier one are merged into it."""
    found = extract(docs, text_col=text_col, keep=True, **options)
    text = F.col(f"row.`{text_col}`")

    def over(chunks: Column) -> Column:
        def step(pos: Column, s: Column) -> tuple[Column, Column]:
            parts = F.array(taken(chunks, pos, s["start"] - pos), F.when(s["kind"] == "", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">"))))
            return F.greatest(pos, s["end"]), F.when(s["start"] >= pos, parts).otherwise(F.expr(NO_FORMS))

        last = F.struct(F.length(text).cast("bigint").alias("start"), F.lit(9).alias("rank"), F.length(text).cast("bigint").alias("end"), F.lit("").alias("kind"))
        return F.array_join(scan(F.concat("spans", F.array(last)), F.lit(0).cast("bigint"), step, "string"), "")

    clean = _once(chunked(text), over)
    out = F.when(text.isNotNull() & (F.size("spans") > 0), clean).otherwise(text)
    return found.select(*[(out if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
