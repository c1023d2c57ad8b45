"""Registered full-text queries over documents, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fts.index import FtsIndex
from ..functions import expr as E
from ..session import shared_dir, table

QUERIES: dict = {}
ORACLE: dict = {}
_TOK = r"""
tok as (select doc_id, c, term, pos from (
  select doc_id, 0 c, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) pos from documents
  union all select doc_id, 1, unnest(regexp_extract_all(lower(source), '[\p{L}\p{N}]+')), generate_subscripts(regexp_extract_all(lower(source), '[\p{L}\p{N}]+'), 1) from documents) t),
len as (select doc_id, count(*)::double l from tok group by 1),
g as (select count(*)::double n, avg(l) mean from (select d.doc_id, coalesce(len.l, 0) l from documents d left join len using (doc_id)) x)"""


_STORED: dict[tuple, str] = {}


def index(spark, sf_dir: str, tokenize: str = "unicode61 remove_diacritics 0", columns=("text", "source"), detail: str = "full") -> FtsIndex:
    """The stored index of documents: built by the first query that needs it in an application, then opened."""
    key = (spark.sparkContext.applicationId, sf_dir, tokenize, columns, detail)
    if key not in _STORED:
        _STORED[key] = _build(spark, sf_dir, tokenize, columns, detail)[1]
    return FtsIndex.open(spark, _STORED[key])


def _build(spark, sf_dir: str, tokenize: str, columns, detail: str) -> tuple[FtsIndex, str]:
    path = f"{shared_dir(spark)}/fts-{uuid.uuid4().hex}"
    return FtsIndex.build(table(spark, sf_dir, "documents"), "doc_id", columns, tokenize, detail).save(path), path


def match(name: str, query: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: index(spark, sf_dir).match(query)
    ORACLE[name] = f"with {_TOK} {sql}"


def _has(term: str) -> str:
    return f"(select distinct doc_id from tok where term = '{term}')"


def _rank(terms: list[str], weights: tuple[float, float] = (1.0, 1.0)) -> str:
    parts = []
    for t in terms:
        parts.append(f"select doc_id, sum(case when c = 0 then {weights[0]!r}::double else {weights[1]!r}::double end) wf, (select count(distinct doc_id) from tok where term = '{t}')::double df from tok where term = '{t}' group by 1")
    return f"""with {_TOK}, hit as ({" union all ".join(parts)})
    select doc_id as rowid, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wf * 2.2 / (wf + 1.2 * (0.25 + 0.75 * l / mean))), 9) as rank from hit join len using (doc_id), g group by 1"""


match("fts_term", "stupid", f"select doc_id as rowid from {_has('stupid')} t")
match("fts_and", "stupid trash", f"select doc_id as rowid from {_has('stupid')} a join {_has('trash')} b using (doc_id)")
match("fts_or", "stupid OR moron OR src7", f"select distinct doc_id as rowid from tok where term in ('stupid', 'moron', 'src7')")
match("fts_not", "(the AND of) NOT (trash OR idiot)", f"select doc_id as rowid from {_has('the')} a join {_has('of')} b using (doc_id) where doc_id not in (select doc_id from tok where term in ('trash', 'idiot'))")
match("fts_phrase", '"of the"', "select distinct a.doc_id as rowid from tok a join tok b on a.doc_id = b.doc_id and a.c = b.c and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'")
match("fts_prefix", "stup* OR \"of th\"*", "select distinct doc_id as rowid from tok where term like 'stup%' union select a.doc_id from tok a join tok b on a.doc_id = b.doc_id and a.c = b.c and b.pos = a.pos + 1 where a.term = 'of' and b.term like 'th%'")
match("fts_column", "source : src7 AND {text source} : the", f"select doc_id as rowid from (select distinct doc_id from tok where term = 'src7' and c = 1) a join {_has('the')} b using (doc_id)")


def fts_bm25_topk(spark, sf_dir):
    d = index(spark, sf_dir).score("stupid OR clown OR thing")
    return d.withColumn("rank", F.round("rank", 9)).orderBy("rank", "rowid").limit(20)


def fts_pruned_topk(spark, sf_dir):
    """Rare and very frequent terms: the frequent ones only add to documents that the rare ones bring in."""
    return index(spark, sf_dir).top("the OR of OR stupid OR clown OR moron", 20).withColumn("rank", F.round("rank", 9))


def fts_bm25f_weights(spark, sf_dir):
    return index(spark, sf_dir).score("src7 OR stupid", [2.0, 10.0]).withColumn("rank", F.round("rank", 9))


def fts_trigram(spark, sf_dir):
    return index(spark, sf_dir, "trigram", ("text",)).match("rash")


def fts_porter(spark, sf_dir):
    return index(spark, sf_dir, "porter unicode61 remove_diacritics 1", ("text",)).score("disgust OR losers").withColumn("rank", F.round("rank", 9)).orderBy("rank", "rowid").limit(20)


def fts_build(spark, sf_dir):
    """The index built anew and stored: its numbers of terms, documents and words."""
    ix = _build(spark, sf_dir, "unicode61 remove_diacritics 0", ("text", "source"), "full")[0]
    words = F.sum(F.aggregate("lens", F.lit(0), lambda a, x: a + x)).cast("long").alias("words")
    return ix.vocabulary.agg(F.count("*").alias("terms")).crossJoin(ix.stats.agg(F.count("*").alias("docs"), words))  # one row each


def fts_index_stats(spark, sf_dir):
    return index(spark, sf_dir).vocabulary.where("docs >= 20").select("term", "docs", "hits")


def hybrid_search(spark, sf_dir):
    """Search joined to its table and a lookup, with tiers, null-guarded filters and a bounded sort."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hits = index(spark, sf_dir).score("stupid OR the")
    low = E.lower(d.text)
    tier = F.when(E.like(d.text, "the %"), 0).when(E.instr(low, " stupid") > 0, 1).otherwise(2)
    out = hits.join(d, hits.rowid == d.doc_id).join(labels, "doc_id", "left").where(d.lang.isNull() | (d.lang == "en")).where(F.coalesce(labels.toxic, F.lit(0)) == 0)
    return out.select("rowid", d.source, tier.alias("tier"), F.round("rank", 9).alias("rank")).orderBy("tier", "rank", "rowid").limit(50)


for f in (fts_bm25_topk, fts_pruned_topk, fts_bm25f_weights, fts_trigram, fts_porter, fts_build, fts_index_stats, hybrid_search):
    QUERIES[f.__name__] = f
ORACLE["fts_bm25_topk"] = _rank(["stupid", "clown", "thing"]) + " order by rank, rowid limit 20"
ORACLE["fts_pruned_topk"] = _rank(["the", "of", "stupid", "clown", "moron"]) + " order by rank, rowid limit 20"
ORACLE["fts_bm25f_weights"] = _rank(["src7", "stupid"], (2.0, 10.0))
ORACLE["fts_trigram"] = "select doc_id as rowid from documents where contains(lower(text), 'rash')"
ORACLE["fts_build"] = f"with {_TOK} select (select count(distinct term) from tok where strlen(term) <= 256) as terms, (select count(*) from documents) as docs, (select count(*) from tok) as words"
ORACLE["fts_index_stats"] = f"with {_TOK} select term, count(distinct doc_id) as docs, count(*) as hits from tok where strlen(term) <= 256 group by term having count(distinct doc_id) >= 20"
ORACLE["hybrid_search"] = f"""select rowid, source, case when lower(text) like 'the %' then 0 when instr(lower(text), ' stupid') > 0 then 1 else 2 end as tier, rank from ({_rank(["stupid", "the"])}) r
 join documents d on d.doc_id = r.rowid left join labels l on l.doc_id = d.doc_id where (lang is null or lang = 'en') and coalesce(toxic, 0) = 0 order by tier, rank, rowid limit 50"""


def fts_append_delete(spark, sf_dir):
    """An index of half of the documents, the other half appended, every seventh deleted; ranked as if built from what is left."""
    d = table(spark, sf_dir, "documents")
    ix = FtsIndex.build(d.where("doc_id % 2 = 0"), "doc_id", ("text",), "unicode61 remove_diacritics 0").append(d.where("doc_id % 2 = 1"), "doc_id")
    return ix.delete(d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("docid"))).score("stupid OR trash").withColumn("rank", F.round("rank", 9))


QUERIES["fts_append_delete"] = fts_append_delete
ORACLE["fts_append_delete"] = _rank(["stupid", "trash"]).replace("from documents", "from documents where doc_id % 7 <> 0").replace("lower(source)", "lower('')").replace("from documents where doc_id % 7 <> 0 d left", "from (select * from documents where doc_id % 7 <> 0) d left")


def _porter_sql(stems: dict[str, tuple[str, ...]]) -> str:
    """Ranks of stemmed terms, each given by the words of the documents that have it."""
    tok = r"""tok as (select doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) term from documents),
len as (select doc_id, count(*)::double l from tok group by 1),
g as (select count(*)::double n, avg(l) mean from (select d.doc_id, coalesce(len.l, 0) l from documents d left join len using (doc_id)) x)"""
    parts = []
    for words in stems.values():
        has = f"term in ({', '.join(repr(w) for w in words)})"
        parts.append(f"select doc_id, count(*)::double wf, (select count(distinct doc_id) from tok where {has})::double df from tok where {has} group by 1")
    return f"""with {tok}, hit as ({" union all ".join(parts)})
    select doc_id as rowid, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * wf * 2.2 / (wf + 1.2 * (0.25 + 0.75 * l / mean))), 9) as rank from hit join len using (doc_id), g group by 1 order by rank, rowid limit 20"""


ORACLE["fts_porter"] = _porter_sql({"disgust": ("disgust", "disgusts", "disgusted", "disgusting"), "loser": ("loser", "losers")})
