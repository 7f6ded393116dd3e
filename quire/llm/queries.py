"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontam, embedding_dedup, html_extract, jaccard_join, language_id, lm_scoring, merkle, packing, periodic, quality, secret_scan, suffix_dedup
from quire.llm.common import fold

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's verdict; the value itself only as a digest."""
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "number", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model, keep=(F.col("doc_id"), held_out.alias("held_out")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"))
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), train=part != 1, deleted=part == 4)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=1024)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), similarity=0.8, width=5)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; that of each fifth is checked against a text that was changed to lower case."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    capitals = "".join(map(chr, range(65, 91)))
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    shown = F.when(changed, leaf(F.translate(F.col("text"), capitals, capitals.lower()))).otherwise(leaf(F.col("text")))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), shown.alias("shown"))
    made = merkle.build(rows, group="source", order=["doc_id"], keep=["doc_id", "shown"])
    again = merkle.folded(F.col("path"), F.col("shown"))
    proved = merkle.proofs(made).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), again.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    back = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, forms=("packed", "decoded"))
    n_tokens = (F.octet_length("packed") / 4).cast("long")
    return back.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, of which a tenth of the documents repeat some by a rule."""
    docs = table(spark, sf_dir, "documents")
    h, g = F.crc32(F.col("doc_id").cast("string")), F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)

    def repeated(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    text = F.coalesce(F.when(h % 10 == 0, changed), F.col("text"))
    found = periodic.runs(docs.select("doc_id", text.alias("text")))
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "b.start",
        "b.length",
        "b.period",
        F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_quality, op4_decontam, op5_lm_scoring, op6_suffix_dedup, op7_packing, op8_jaccard_join, op9_embedding_dedup, op10_html_extract, op11_merkle_manifest, op12_byte_bpe, op13_periodic_runs)
}


_CRC = "xor(list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ord(c) as bigint) for c in string_split(cast({0} as varchar), '')]), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _merkle_sql(levels: int = 6, above: int = 4) -> str:
    """Trees of at most 16**levels rows in at most 16**above groups, one level after another."""
    field = lambda c: f"coalesce(cast(octet_length(encode(cast({c} as varchar))) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sides = [("s", k, "b.idx") for k in range(levels)] + [("t", k, "b.top") for k in range(above)]
    met = lambda side, k, own: f"{'x.tree is not distinct from b.source and ' if side == 's' else ''}x.n > 1 and x.idx // 16 = {own} // {16 ** (k + 1)}"
    up = lambda t, k: f"{t}{k + 1} as (select tree, idx // 16 as idx, (n + 15) // 16 as n, sha256(string_agg(h, '' order by idx)) as h from {t}{k} where n > 1 group by all union all select tree, idx, n, h from {t}{k} where n = 1)"
    parts = [
        f"leaves as (select doc_id, source, {leaf('text')} as leaf, case when {_CRC.format('doc_id')} % 5 = 0 then {leaf(lower)} else {leaf('text')} end as shown from documents)",
        "base as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as idx, count(*) over (partition by source) as n, row_number() over (order by source, doc_id, leaf) as k from leaves)",
        "s0 as (select source as tree, idx, n, leaf as h from base)",
        *(up("s", k) for k in range(levels)),
        f"t0 as (select tree as source, 0 as tree, row_number() over (order by tree nulls first) - 1 as idx, count(*) over () as n, h from s{levels})",
        *(up("t", k) for k in range(above)),
        "placed as (select b.*, t.idx as top, t.h as subroot from base b join t0 t on t.source is not distinct from b.source)",
        "near as (" + " union all ".join(f"select b.k, {o} as o, x.idx, x.h from placed b join {t}{k} x on {met(t, k, own)} and x.idx <> {own} // {16**k}" for o, (t, k, own) in enumerate(sides)) + ")",
        "proof as (select k, sha256(string_agg(h, '' order by o, idx)) as proof_sha256 from near group by k)",
        "f0 as (select k, shown as h from base)",
        *(
            f"f{o + 1} as (select b.k, case when count(x.idx) > 0 then sha256(string_agg(case when x.idx = {own} // {16**k} then f.h else x.h end, '' order by x.idx)) else any_value(f.h) end as h from placed b join f{o} f using (k) left join {t}{k} x on {met(t, k, own)} group by b.k)"
            for o, (t, k, own) in enumerate(sides)
        ),
    ]
    return f"""with {", ".join(parts)}
        select b.doc_id, b.leaf, b.subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
        from placed b join f{len(sides)} f using (k) left join proof p using (k), (select h from t{above}) r"""


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontam": f"""
        with items as (select item_id, {_WORDS.format("text")} as w from benchmark),
        windows as (
            select distinct item_id, w[i : least(i + 12, len(w))] as win
            from items, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i) where len(w) > 0),
        lengths as (select distinct len(win) as n from windows),
        docs as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
        places as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths),
        cut as (select p.doc_id, p.n, p.i, d.w[p.i : p.i + p.n - 1] as win from places p join docs d using (doc_id)),
        hits as (select c.doc_id, c.i, c.n, v.item_id from cut c join windows v on c.win = v.win),
        covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hits) group by doc_id),
        found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items,
               sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
        from docs d left join covered c using (doc_id) left join found f using (doc_id)""",
    "op11_merkle_manifest": _merkle_sql(),
    "op8_jaccard_join": f"""
        with recursive docs as (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
        places as (select doc_id, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0),
        shingles as (select distinct p.doc_id, array_to_string(d.w[p.i : least(p.i + 4, len(d.w))], ' ') as s from places p join docs d using (doc_id)),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
        links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 10 * k >= 8 * (x.n + y.n - k)),
        reach(doc_id, other) as (select doc_id, doc_id from docs union select r.doc_id, l.b from reach r join links l on l.a = r.other),
        classes as (select doc_id, min(other) as class_id from reach group by doc_id)
        select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.n, 0) as n_links, c.class_id
        from docs d join classes c using (doc_id) left join sizes s using (doc_id)
        left join (select a as doc_id, count(*) as n from links group by a) l using (doc_id)""",
    "op9_embedding_dedup": """
        with recursive v as (
            select vec_id, label, cast(embedding as double[]) as e,
                   label is not null and embedding is not null and len(embedding) > 0
                   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
                   and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
            where a.ok and b.ok and len(a.e) = len(b.e)
              and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
        reach(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, l.b from reach r join links l on l.a = r.other),
        least_ as (select vec_id, min(other) as component_id from reach group by vec_id)
        select v.vec_id, coalesce(l.n, 0) as n_links, m.component_id, v.vec_id = m.component_id as kept
        from v join least_ m using (vec_id) left join (select a as vec_id, count(*) as n from links group by a) l using (vec_id)""",
}
