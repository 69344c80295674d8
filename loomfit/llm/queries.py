"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(read(spark, sf_dir, "documents"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.element_at("positions", 1), 6).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP1_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rnk from s),
w as (select *, (rnk % 3 + 1)::double as w, source_size * 3.0::double as cap, sum(source_size) over ()::double as total from r),
u as (select *, coalesce(sum(cap) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0) as used,
  sum(w) over (order by cap / w, rnk rows between current row and unbounded following) as open_w, row_number() over (order by cap / w, rnk) as pos_at from w),
l as (select arg_min((total - used) / open_w, pos_at) as level from u where (total - used) / open_w <= cap / w),
t as (select source, rnk, source_size, coalesce(least(cap, w * level), cap) as target from u left join l on true),
c as (select d.doc_id, d.size, t.rnk, t.source_size, t.target, floor(t.target + 0.5)::bigint as goal,
  coalesce(sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as c
  from d join t on d.source is not distinct from t.source),
p as (select *, case when source_size > 0 then goal // source_size else 0 end as passes from c),
k as (select *, greatest(0, least(size, goal - passes * source_size - c)) as part from p),
x as (select *, (passes * size + part)::bigint as taken, c / target as u from k)
select doc_id, size, source_size, target, taken, case when taken > 0 then round(case rnk % 3
  when 0 then case when u * 1.0 <= 0 then 0 else 2 * u / (2 + sqrt(greatest(4 - 4 * u, 1e-300))) end
  when 1 then u else case when u <= 0 then 0 else 2 * u / sqrt(greatest(4 * u, 1e-300)) end end, 6) end as position from x
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": OP1_SQL}


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import drop_repeats

    return drop_repeats(read(spark, sf_dir, "documents"), keep_text=False)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import cut_lines

    out = cut_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
c as (select k, max(doc_id) as last from k where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
j as (select k.*, c.last is not null and k.doc_id < c.last as gone from k left join c using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from j group by doc_id
"""

#: Every shared shingle is a link's witness, so pairs are joined on shingles (exact, quadratic).
OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
h as (select s.doc_id, hash(s.s) as s, n.n from s join n using (doc_id)),
p as (select a.doc_id as a, b.doc_id as b from h a join h b on a.s = b.s and a.doc_id < b.doc_id and least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
r as (select doc_id as id, doc_id as c from w union select e.b, r.c from r join e on e.a = r.id),
m as (select id, min(c) as c from r group by id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, m.c = w.doc_id as kept from w left join n using (doc_id) join m on m.id = w.doc_id
"""

OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, greatest(len(w) - 48, 1))) as p, w from w),
h as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from p),
m as (select h, min(doc_id) as lo from h group by h having min(doc_id) < max(doc_id)),
g as (select distinct doc_id, unnest(range(p, p + 50)) as i from h join m using (h) where doc_id > lo),
x as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from w),
k as (select x.doc_id, count(*) as n, count(g.i) as gone, string_agg(x.t, ' ' order by x.i) filter (g.i is null) as kept from x left join g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select w.doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""

QUERIES |= {"op4_near_duplicates": op4_near_duplicates, "op5_substrings": op5_substrings, "op9_lines": op9_lines}
ORACLES |= {"op4_near_duplicates": OP4_SQL, "op5_substrings": OP5_SQL, "op9_lines": OP9_SQL}


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    out = encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES |= {"op3_bpe": op3_bpe}


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import telephony

    return telephony(read(spark, sf_dir, "documents")).drop("media")  # the file stays in its table


QUERIES |= {"op6_quality": op6_quality, "op7_telephony": op7_telephony}


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES |= {"op2_nearest": op2_nearest, "op10_toxicity": op10_toxicity}


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


QUERIES |= {"op8_lm_scores": op8_lm_scores}
