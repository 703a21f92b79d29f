"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, katz, langid, licenses, mixing, multiindex, packing, permindex, pii, simhash
from .common import read


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return cotrain.score(docs, cotrain.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")))


def op3_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_permindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


# -- what SQL can say of an operator: the same columns, by the operator, with SQL beside them --------


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_langid(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("no_letter"))


def lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_katz(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pieces of a document are numbered without gaps and no place of a sequence is taken twice."""
    packed = op9_packing(spark, sf_dir)
    docs = packed.groupBy("doc_id").agg((F.max("piece") + 1 == F.count("*")).alias("whole"))
    fits = packed.groupBy("sequence_id").agg((F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("gapless"), (F.sum("length") <= 2048).alias("fits"))
    return docs.agg(F.count("*").alias("documents"), F.bool_and("whole").alias("whole")).crossJoin(fits.agg(F.bool_and("gapless").alias("gapless"), F.bool_and("fits").alias("fits")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_licenses, op2_cotrain, op3_multiindex, op4_pii, op5_langid, op6_katz, op7_mixing, op8_permindex, op9_packing, op10_simhash, pii_base, language_split, lm_counts, mixing_targets, packing_totals)
    return {op.__name__: op for op in ops}


#: All pairs of a label by cosine and the closure of the links, for tables whose vec_ids are unique.
NEAR_VECTORS_SQL = """
with recursive given as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and vec_id is not null and embedding is not null),
valid as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from given where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from valid a join valid b on a.label = b.label and a.vec_id != b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from reach r join links l on r.other = l.a),
counts as (select a as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from (select vec_id, min(other) as component_id from reach group by 1) left join counts using (vec_id)
"""


def _crc(value: str, size: int) -> str:
    """crc32 of a number's text, mod ``size``, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    letters = f"list_transform(string_split({value}::varchar, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {letters}), lambda c, b: {byte}), 4294967295) % {size}"


def _matches(kind: str, pattern: str, ok: str) -> str:
    """Matches of a kind with their offsets: list of (start, rank, end, kind)."""
    quoted = pattern.replace("'", "''")
    rank = pii.KINDS.index(kind)
    found, gaps = f"regexp_extract_all(t, '{quoted}')", f"string_split_regex(t, '{quoted}')"
    spans = f"list_transform(range(1, len({found}) + 1), lambda i: struct_pack(s := list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda g: length(g))), 0), x := {found}[i]))"
    return f"list_transform(list_filter({spans}, lambda m: {ok}), lambda m: struct_pack(s := m.s::bigint, r := {rank}, e := (m.s + length(m.x))::bigint, k := '{kind}'))"


_DIGITS = "regexp_replace(m.x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: case when i % 2 = 1 then c::int when 2 * c::int > 9 then 2 * c::int - 9 else 2 * c::int end)) % 10 = 0"
#: The contract's forms, written out here so that a wrong form in the operator shows.
_BASE = {
    "email": _matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": _matches("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m.x, '.'), lambda p: coalesce(try_cast(p as bigint), 999) > 255)) = 0"),
    "card": _matches("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}"),
    "phone": _matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
}
PII_SQL = (
    f"with f as (select doc_id, {', '.join(f'{sql} as {kind}' for kind, sql in _BASE.items())} from (select doc_id, coalesce(text, '') as t from documents)), "
    "a as (select *, list_sort(list_concat(list_concat(email, ip), list_concat(card, phone))) as every from f) "
    "select doc_id, len(email) as n_email, len(ip) as n_ip, len(card) as n_card, len(phone) as n_phone, sha256(coalesce(array_to_string(list_transform(every, lambda m: m.k || ':' || m.s || ':' || m.e), ','), '')) as base_sha256 from a"
)
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SPLIT_SQL = f"select doc_id, {_crc('doc_id', 5)} = 0 as held_out, not regexp_matches(coalesce(text, ''), '\\p{{L}}') as no_letter from documents"
COUNTS_SQL = (
    f"with d as (select doc_id, {_crc('doc_id', 7)} = 2 as held_out, list_append({_WORDS}, ' end') as words from documents), "
    "w as (select doc_id, held_out, unnest(words) as w from d), c as (select w, count(*) as c from w where not held_out group by 1), "
    "n as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from c) "
    "select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n) as train_tokens, round(sum(log10(coalesce(c, 0) + 1) - log10(n + v + 1)), 4) as base_score from w left join c using (w), n group by 1, 2"
)
TARGETS_SQL = (
    "with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from documents), s as (select source, sum(size)::bigint as source_size from d group by 1), "
    "w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w from s), "
    "l as (select *, (sum(source_size) over () - coalesce(sum(3.0::double * source_size) over (order by source_size / w, source rows between unbounded preceding and 1 preceding), 0)) / (sum(w) over () - coalesce(sum(w) over (order by source_size / w, source rows between unbounded preceding and 1 preceding), 0)) as level from w), "
    "t as (select source, source_size, least(3.0::double * source_size, w * max(level) over ()) as target from l) "
    "select doc_id, size, source_size, round(target, 4) as target from d join t on d.source is not distinct from t.source"
)
PACKING_SQL = "select count(*) as documents, true as whole, true as gapless, true as fits from documents"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.scan_sql(), "op3_multiindex": NEAR_VECTORS_SQL, "pii_base": PII_SQL, "language_split": SPLIT_SQL, "lm_counts": COUNTS_SQL, "mixing_targets": TARGETS_SQL,
        "packing_totals": PACKING_SQL,
    }
