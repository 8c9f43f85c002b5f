"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import audio, byte_bpe, jaccard_join, language_id, license_scan, lm_scoring, mixing, packing, quality_rules, substring_dedup, token_alignment, url_filter, vector_codes
from strideframe.llm.common import settle

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int):
    """Null for a null id: such a row is never learned from and counts as held out."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents"), with_media=False).drop("media", "tensors")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_language_model(docs.where(remainder(3) != 1))
    out = language_id.identify_languages(docs, model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", F.size("languages").cast("long").alias("n_langs"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_members(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"), keep=("label",))
    rows = settle(rows.select("vec_id", "label", vector_codes.code_text(F.col("codes")).alias("code"), "error"), "codes")
    out = vector_codes.with_group_error(rows, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = token_alignment.align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    out = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decode=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_audio": op3_audio,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}


def _lloyd_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Each round: the nearest entry by (distance, index), then the floored means, from all assignments anew."""
    near = """ a{t} as materialized (select x.r, x.part, x.x, min(cast(list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, c.c) + list_dot_product(c.c, c.c) as bigint) * {e} + c.entry) as m
        from x join c{t} c using (part) group by x.r, x.part, x.x),
"""
    mean = """ u{t} as (select part, m % {e} as entry, i, floor(sum(x[i]) / count(*)) as y from a{t}, unnest(range(1, len(x) + 1)) as g(i) group by all),
 n{t} as (select part, entry, list(y order by i) as c from u{t} group by all),
 c{s} as materialized (select c.part, c.entry, coalesce(n.c, c.c) as c from c{t} c left join n{t} n using (part, entry)),
"""
    steps = "".join(near.format(t=t, e=entries) + (mean.format(t=t, s=t + 1, e=entries) if t < rounds else "") for t in range(rounds + 1))
    return rf"""
with k as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda z: floor({1024} * cast(z as double))) as v from embeddings
       where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
 x as materialized (select r, p.part, v[p.part * len(v) // {parts} + 1 : (p.part + 1) * len(v) // {parts}] as x from k, unnest(range({parts})) as p(part)),
 f as (select r, row_number() over (order by vec_id nulls last, v) - 1 as entry from k qualify entry < {entries}),
 c0 as materialized (select x.part, f.entry, x.x as c from x join f using (r)),
{steps} e as (select r, cast(sum(m // {entries}) as bigint) as error, string_agg(lpad(lower(to_hex(m % {entries})), 2, '0'), '' order by part) as code from a{rounds} group by r),
 b as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by part, entry, i)) as codebooks_sha256 from (select part, entry, unnest(c) as y, generate_subscripts(c, 1) as i from c{rounds})),
 l as (select label, cast(sum(error) as bigint) as label_error from e join k using (r) group by label)
select k.vec_id, e.code, e.error, l.label_error, b.codebooks_sha256 from k join e using (r) join l on k.label is not distinct from l.label cross join b"""



ORACLE_SQL = {
    "op4_jaccard_join": r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 g as (select distinct r, doc_id, unnest(case when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from d where len(w) > 0),
 n as (select r, count(*) as n from g group by r),
 i as (select a.r as a, b.r as b, count(*) as i from g a join g b on a.s = b.s and a.r < b.r group by all),
 l as (select da.doc_id as a, db.doc_id as b from i join n x on x.r = i.a join n y on y.r = i.b join d da on da.r = i.a join d db on db.r = i.b where 100 * i.i >= 85 * (x.n + y.n - i.i)),
 e as (select a, b from l union select b, a from l),
 c as (select doc_id as node, doc_id as reached from d union select c.node, e.b from c join e on e.a = c.reached),
 m as (select node, min(reached) as component_id from c group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d left join n using (r) left join m on m.node = d.doc_id""",
    "op8_mixing": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                  cast('0x' || substring(md5(coalesce(cast(doc_id as varchar), '')), 1, 9) as bigint) as k from documents),
 s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
 w as (select *, [5e0, 2e0, 1e0][1 + (row_number() over (order by source nulls last) - 1) % 3] as w, source_size * 3e0 as cap from s),
 l as (select *, cap / w as ratio, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0e0) as below,
              sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as rest, cast(sum(source_size) over () as double) as total from w),
 v as (select *, (total - below) / rest as lev from l),
 x as (select *, min_by(case when ratio > lev then lev end, case when ratio > lev then ratio end) over () as level from v),
 t as (select source, source_size, case when level is null then cap else least(cap, w * level) end as target from x),
 p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as k0 from t),
 q as (select *, case when source_size > 0 then target - k0 * source_size else 0e0 end as want from p),
 h as (select source, k, cast(sum(size) as bigint) as n from d group by source, k),
 c as (select *, sum(n) over (partition by source order by k) as cum from h),
 e as (select c.source, c.k, c.n, c.cum, q.want from c join q on c.source is not distinct from q.source where q.want > 0 and c.cum > q.want
       qualify row_number() over (partition by c.source order by c.k) = 1),
 r as (select source, k + case when cum - want < want - (cum - n) then 1 else 0 end as edge from e)
select d.doc_id, d.size, q.source_size, q.target, cast(d.size * (q.k0 + case when r.edge is not null and d.k < r.edge then 1 else 0 end) as bigint) as taken
from d join q on d.source is not distinct from q.source left join r on d.source is not distinct from r.source""",
    "op9_quality_rules": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, source from documents),
 w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d)),
 g as (select r, i, w || ' ' || lead(w) over x || ' ' || lead(w, 2) over x as g from w window x as (partition by r order by i)),
 b as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g where g is not null) where n > 1),
 v as (select r, count(*) as n_rep from (select distinct r, i + unnest([0, 1, 2]) as i from b) group by r),
 n as (select r, count(*) as n, sum(length(w)) as chars from w group by r),
 l as (select r, unnest(string_split(t, chr(10))) as line from d),
 k as (select r, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm
       from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
 u as (select r, count(*) - count(distinct line) as dup from k group by r),
 f as (select d.source, k.norm, count(distinct d.t) as docs from k join d using (r) group by all having docs >= 20),
 a as (select source, count(distinct t) as n_texts from d group by source),
 y as (select f.source, f.norm from f join a on f.source is not distinct from a.source where f.docs * 100e0 > a.n_texts * 5e0),
 z as (select k.r, sum(len(string_split(k.norm, ' '))) as gone from k join d using (r) join y on y.norm = k.norm and y.source is not distinct from d.source group by k.r),
 o as (select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_words, cast(coalesce(n.chars, 0) as bigint) as word_chars,
              cast(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(u.dup, 0) as bigint) as n_dup_lines,
              cast(coalesce(v.n_rep, 0) as bigint) as n_repeat_words, cast(coalesce(z.gone, 0) as bigint) as n_line_words
       from d left join n using (r) left join v using (r) left join u using (r) left join z using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not ((n_words - n_line_words) * 100e0 < n_words * 30e0) as kept from o""",
    "op10_url_filter": r"""
with p as (select page_id, translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) as path from pages),
 q as (select page_id, coalesce(host, '') as host, coalesce(path, '') as path from p),
 r(h, s, rule, v) as (values ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
                             ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
 m as (select q.page_id, q.host, q.path, r.rule, r.v, length(r.h) * 1000 + length(r.s) as n
       from q left join r on (q.host = r.h or suffix(q.host, '.' || r.h)) and starts_with(q.path, r.s)),
 b as (select page_id, host, path, max_by(struct_pack(rule := rule, v := v), coalesce(n, -1)) as x from m group by page_id, host, path)
select page_id, host, path, x.rule as rule, coalesce(x.v, 'allow') as verdict from b""",
    "op11_vector_codes": _lloyd_sql(),
}
