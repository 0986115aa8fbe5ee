"""Registered queries of this package: the operators over the whole given tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, language, lines, lm, mixing, neardup, negatives, pii, quality, secrets, sharding, substrings

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), SHARDS)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out(F.col("doc_id"))
    model = language.train(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents"), k=2)


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_digest(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(table(spark, folder, "documents")).drop("copies")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [_count(base, kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.verdicts(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"
    )


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    counts = [_count(base, kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _joined(spans):
    """kind:start:end of every span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256)).drop("items")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0, "vec_id", "label", "embedding")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_digest(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_language_id, op3_near_duplicates, op4_lm_scores, op5_substring_dedup, op6_mixing, op7_secrets, op8_quality_rules, op9_decontamination, op10_pii,
    op11_hard_negatives, op12_collocations, op13_line_dedup,
)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + least(2, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by all
), edges as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (
  select a, b from edges union all select b, a from edges
), reach as (
  select doc_id, doc_id as node from documents
  union
  select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.node
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least_id as component_id, doc_id = least_id as kept
from (select doc_id, min(node) as least_id from reach group by doc_id) left join sizes using (doc_id)
""",
    "op4_lm_scores": rf"""
with parts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
), words as (
  select doc_id, unnest(w) as z, generate_subscripts(w, 1) as i from parts
), total as (
  select count(*) as total_words from words
), places as (
  select c.doc_id, c.i, a.z as x, b.z as y, c.z from words c
  left join words b on b.doc_id = c.doc_id and b.i = c.i - 1 left join words a on a.doc_id = c.doc_id and a.i = c.i - 2
), singles as (
  select z, count(*) as n from words group by z
), own_pairs as (
  select doc_id, y, z, count(*) as own from places where i > 1 group by all
), pairs as (
  select y, z, sum(own) as n from own_pairs group by all
), own_triples as (
  select doc_id, x, y, z, count(*) as own from places where i > 2 group by all
), triples as (
  select x, y, z, sum(own) as n from own_triples group by all
), found as (
  select p.doc_id, p.i, t.n - ot.own as others3, before.n as n_before, d.n - od.own as others2, sy.n as n_y, sz.n as n_z
  from places p join singles sz on sz.z = p.z
  left join singles sy on sy.z = p.y
  left join pairs d on d.y = p.y and d.z = p.z left join own_pairs od on od.doc_id = p.doc_id and od.y = p.y and od.z = p.z
  left join pairs before on before.y = p.x and before.z = p.y
  left join triples t on t.x = p.x and t.y = p.y and t.z = p.z
  left join own_triples ot on ot.doc_id = p.doc_id and ot.x = p.x and ot.y = p.y and ot.z = p.z
), logs as (
  select doc_id, (i > 2 and others3 = 0) or (i = 2 and others2 = 0) as backed, round(1e6 * log10(case
    when others3 > 0 then others3 / n_before::double
    when others2 > 0 then case when i > 2 then 0.4::double else 1 end * others2 / n_y::double
    else case when i > 2 then 0.4::double * 0.4::double when i = 2 then 0.4::double else 1 end * n_z / total_words::double end)) as log
  from found, total
), summed as (
  select doc_id, sum(log) as total, count(*) filter (where backed) as n_backed_off from logs group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_backed_off, 0)::bigint as n_backed_off,
  coalesce(total, 0) / 1e6::double as log_score, coalesce(total, 0) / 1e6::double / nullif(len(w), 0)::double as mean_log_score
from parts left join summed using (doc_id)
""",
    "op5_substring_dedup": rf"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)
), firsts as (
  select s, min(doc_id) as first_id from windows group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as word from windows join firsts using (s) where first_id < doc_id
), placed as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as word from words
), kept as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by word) as kept_text from placed anti join gone using (doc_id, word) group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept_text, '')) as kept_sha256
from words left join kept using (doc_id)
""",
    "op6_mixing": rf"""
with recursive sized as (
  select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from totals
), levels as (
  select 0 as round, 0::double as level, -1::bigint as stopped
  union all
  select round + 1, (select (sum(source_size) * 150.0::double / 100 - 2 * coalesce(sum(case when round > 0 and level * weight > source_size * 2 then source_size end), 0))
             / sum(case when round > 0 and level * weight > source_size * 2 then 0 else weight end) from weighted),
         (select count(*) from weighted where round > 0 and level * weight > source_size * 2)
  from levels where round < 40 and stopped < (select count(*) from weighted where round > 0 and level * weight > source_size * 2)
), goals as (
  select source, source_size, least(level * weight, (source_size * 2)::double) as target
  from weighted, (select level from levels order by round desc limit 1)
), rated as (
  select doc_id, text, size, source_size, target, coalesce(target / nullif(source_size, 0)::double, 0) as rate
  from sized join goals on sized.source is not distinct from goals.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || md5('mix:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))))[1:13])::bigint::double / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
""",
    "op8_quality_rules": rf"""
with words as (
  select doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
), lined as (
  select doc_id, source, text, nr, line, lw from (
    select doc_id, source, text, nr, line, regexp_extract_all(line, '{_WORD}') as lw
    from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as nr from documents)
  ) where len(lw) > 0
), duplicates as (
  select doc_id, sum(n - 1)::bigint as n_dup_lines from (select doc_id, line, count(*) as n from lined group by all) group by doc_id
), triples as (
  select doc_id, i, array_to_string(w[i : i + 2], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) > 2)
), again as (
  select doc_id, i from triples join (select doc_id, t from triples group by all having count(*) > 1) using (doc_id, t)
), repeats as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 3)) as p from again) group by doc_id
), normal as (
  select doc_id, source, text, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as line, sum(len(lw)) as n
  from lined group by all
), base as (
  select doc_id, len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed from words left join repeats using (doc_id)
), frequent as (
  select source, line, min(doc_id) filter (where not base_failed) as first_id from normal join base using (doc_id)
  group by source, line having count(distinct doc_id) > 20
), lost as (
  select doc_id, sum(n)::bigint as n_removed from normal join frequent on normal.line = frequent.line and normal.source is not distinct from frequent.source
  where doc_id is distinct from first_id group by doc_id
), all_of as (
  select doc_id, base_failed, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_removed, 0)::bigint as n_removed
  from words join base using (doc_id) left join duplicates using (doc_id) left join repeats using (doc_id) left join lost using (doc_id)
)
select *, not base_failed and 2 * (n_words - n_removed) >= n_words as kept from all_of
""",
    "op9_decontamination": r"""
with parts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(13, len(w)) as m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as words
  from (select item_id, w, unnest(range(1, greatest(0, len(w) - least(13, len(w)) + 1) + 1)) as i from items where len(w) > 0)
), lengths as (
  select distinct m from windows
), places as (
  select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') as words
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from parts, lengths where len(w) >= m)
), hits as (
  select doc_id, i, places.m, item_id from places join windows using (m, words)
), covered as (
  select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(i, i + m)) as word from (select distinct doc_id, i, m from hits)) group by doc_id
), named as (
  select doc_id, count(distinct item_id::varchar) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names
  from (select distinct doc_id, item_id from hits) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from parts left join covered using (doc_id) left join named using (doc_id)
""",
    "op11_hard_negatives": """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double)::bigint for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), anchors as (
  select distinct * from vectors where vec_id % 100 = 0
), scores as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, coalesce(list_sum([a.v[i] * b.v[i] for i in range(1, least(len(a.v), len(b.v)) + 1)]), 0)::bigint as score
  from anchors a, vectors b where a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
""",
    "op12_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null
), split as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w))::bigint as n from split group by lang
), grams as (
  select lang, w[i : i + m - 1] as g
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest([1, 2, 3, 4]) as m from split) where len(w) >= m)
), phrases as (
  select lang, g, count(*)::bigint as f from grams group by all having count(*) >= 30
), held as (
  select lang, g[i : i + m - 1] as part, max(f) as most
  from (select lang, g, f, m, unnest(range(1, len(g) - m + 2)) as i from (select lang, g, f, unnest(range(2, len(g))) as m from phrases where len(g) > 2)) group by all
), candidates as (
  select p.lang, p.g, f as a from phrases p left join held h on h.lang = p.lang and h.part = p.g
  where len(p.g) > 1 and not coalesce(100::hugeint * most >= 80::hugeint * f, false)
), cuts as (
  select lang, g, a, unnest(range(1, len(g))) as k from candidates
), scored as (
  select c.lang, array_to_string(c.g, ' ') as phrase, a, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint as score
  from cuts c join phrases x on x.lang = c.lang and x.g = c.g[1 : k] join phrases y on y.lang = c.lang and y.g = c.g[k + 1 : len(c.g)]
  qualify row_number() over (partition by c.lang, c.g order by score, k) = 1
)
select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::int as rank, phrase, a, l, r, n, score
from scored join totals using (lang) qualify rank <= 2000
""",
    "op13_line_dedup": """
with lined as (
  select distinct doc_id, md5(coalesce(text, '')) as t, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lined
), shared as (
  select key, max(doc_id) as largest from keyed where length(key) >= 20 and doc_id is not null group by key having count(distinct doc_id) >= 3
), judged as (
  select doc_id, t, pos, line, coalesce(doc_id <> largest, false) as gone from keyed left join shared using (key)
), folded as (
  select doc_id, t, count(*) as n_lines, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by pos) filter (not gone) as kept from judged group by all
)
select d.doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from documents d join folded f on f.doc_id is not distinct from d.doc_id and f.t = md5(coalesce(d.text, ''))
""",
}
