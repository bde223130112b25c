"""Structured search — exact filters, optional BM25 name match, paging.

``search`` answers one request (the reference's endpoint) as a filtered, ordered,
offset/limit plan whose predicates Catalyst pushes into the Parquet scan.

``batch_search`` answers a whole table of requests in one plan. Requests are grouped by
which equality fields they set (at most 8 patterns of industry / size_range / country);
every company row is keyed once per pattern in use, and filter sets join companies on
(pattern, key), on a tag, on a founding year or on the hits of the name index. Pages are cut with ``row_number() <= page*size`` (WindowGroupLimit,
applied partially before the shuffle).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facets import FacetIndex, build_facet_index, facet_hits
from .sizing import bounded_broadcast
from .textindex import TextIndex, bm25, build_text_index

EQ_FIELDS = ("industry", "size_range", "country")


@dataclass
class SearchRequest:
    name: str | None = None
    industry: str | None = None
    size_range: str | None = None
    country: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    tags: list[str] | None = field(default=None)
    page: int = 1
    size: int = 10

    def offset(self) -> int:
        if self.page < 1 or self.size < 0:
            raise ValueError("page must be >= 1 and size >= 0")
        return (self.page - 1) * self.size


def search_predicate(req: SearchRequest) -> Column:
    """AND of the criteria present (falsy values are absent); TRUE when none."""
    preds: list[Column] = []
    for f in EQ_FIELDS:
        v = getattr(req, f)
        if v:
            preds.append(F.col(f) == F.lit(v.lower()))
    for t in req.tags or []:
        preds.append(F.array_contains(F.col("tags"), F.lit(t).cast("string")))
    if req.year_from:
        preds.append(F.col("year_founded") >= F.lit(int(req.year_from)))
    if req.year_to:
        preds.append(F.col("year_founded") <= F.lit(int(req.year_to)))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def name_index(companies: DataFrame, materialize: bool = False, layout: str = "term") -> TextIndex:
    """Text index of the ``name`` field (statistics over the whole corpus, as in the engine).
    Materialised with term-bucketed postings by default: requests read only the buckets
    of their terms."""
    return build_text_index(companies, "company_id", "name", materialize=materialize, name="idx-company-name",
                            layout=layout)


def search(companies: DataFrame, req: SearchRequest, index: TextIndex | None = None) -> DataFrame:
    """One request → one page of companies.

    Filter-only requests have constant score, so the order is ``company_id``; a name
    request orders by BM25 score desc, then ``company_id``. Adds ``score`` (NULL when no
    name) and ``rank`` (1-based within the page).
    """
    off = req.offset()
    hits = companies.where(search_predicate(req))
    if req.name:
        idx = index or name_index(companies)
        spark = companies.sparkSession
        q = spark.createDataFrame([(0, req.name)], "query_id long, query string")
        s = bm25(idx, q).select(F.col("doc_id").alias("company_id"), F.round("score", 6).alias("score"))
        hits = hits.join(s, "company_id")
        order = [F.col("score").desc(), F.col("company_id").asc()]
    else:
        hits = hits.withColumn("score", F.lit(None).cast("double"))
        order = [F.col("company_id").asc()]
    w = Window.orderBy(*order)
    page = hits.orderBy(*order).offset(off).limit(req.size)
    # rank within the page: the page is at most ``size`` rows, one partition
    return page.withColumn("rank", F.row_number().over(w))


def _norm_requests(requests: DataFrame) -> DataFrame:
    r = requests
    for f in EQ_FIELDS:
        r = r.withColumn(f, F.lower(F.nullif(F.col(f), F.lit(""))))
    bits = [F.when(F.col(f).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(EQ_FIELDS)]
    pattern = reduce(lambda a, b: a + b, bits)
    return (r.withColumn("pattern", pattern)
            .withColumn("eq_key", F.concat_ws("\u0001", *[F.coalesce(F.col(f), F.lit("")) for f in EQ_FIELDS]))
            .withColumn("page", F.coalesce(F.col("page"), F.lit(1)))
            .withColumn("size", F.coalesce(F.col("size"), F.lit(10))))


def _company_key(pattern: int) -> Column:
    return F.concat_ws("\u0001", *[F.col(f) if pattern & (1 << i) else F.lit("") for i, f in enumerate(EQ_FIELDS)])


def batch_search(companies: DataFrame, requests: DataFrame, index: TextIndex | None = None,
                 max_broadcast_requests: int = 200_000, facets: FacetIndex | None = None) -> DataFrame:
    """Many requests at once.

    ``requests``: request_id, name, industry, size_range, country, year_from, year_to,
    tags (array<string>), page, size. Returns request_id, rank, company_id, score and
    the company columns.

    Identical filter sets are answered once (single flight) and joined back. Every kind of filter
    set meets the companies by an equi-join, none by a nested loop:

    * equality criteria alone: companies of the keys asked for, each key cut to the largest page end of
      these requests before the join (a partial WindowGroupLimit runs in every task ahead of the shuffle);
    * tags, with or without equality criteria: by bitmaps (``facets``, built here if not given); years are
      a residual predicate. A company without tags has none, NULL elements are no tags, and a request
      for a NULL tag finds nothing;
    * years, alone or with equality criteria: on the key and each founding year in the range, whose companies
      are cut as above;
    * names: from the hits of the text index to their companies.
    """
    req = _norm_requests(requests)
    bad = req.where((F.col("page") < 1) | (F.col("size") < 0)).limit(1).count()
    if bad:
        raise ValueError("page must be >= 1 and size >= 0")
    fcols = ["pattern", "eq_key", "name", "year_from", "year_to", "tags"]
    req = req.withColumn("fs_id", F.sha2(F.to_json(F.struct(*fcols)), 256))
    named = F.col("name").isNotNull() & (F.col("name") != "")
    dated = (F.coalesce(F.col("year_from"), F.lit(0)) != 0) | (F.coalesce(F.col("year_to"), F.lit(0)) != 0)
    tagged = F.coalesce(F.size("tags"), F.lit(0)) > 0
    # bounded scalars: the distinct patterns (at most 2^3 = 8 values), the largest page end, which kinds occur
    end, plain = F.col("page") * F.col("size"), ~named & ~dated & ~tagged
    by_years = ~named & dated & ~tagged
    stats = req.agg(F.collect_set("pattern").alias("p"), F.max(end).alias("k"), F.max(F.when(plain, end)).alias("plain_end"),
                    F.max(F.when(by_years, end)).alias("years_end"), F.max(named).alias("named"), F.max(by_years).alias("dated"),
                    F.max(~named & tagged).alias("tagged")).first()
    patterns, max_end = sorted(stats["p"] or []), int(stats["k"] or 0)
    if not patterns or max_end == 0:
        return companies.limit(0).withColumns({"request_id": F.lit(None).cast("long"), "rank": F.lit(0),
                                               "score": F.lit(None).cast("double")})
    fsets = req.groupBy("fs_id", *fcols).agg(F.max(F.col("page") * F.col("size")).alias("need"))
    r = fsets.select("fs_id", F.col("pattern").alias("r_pattern"), F.col("eq_key").alias("r_key"), F.col("name").alias("r_name"),
                     F.col("year_from").alias("r_from"), F.col("year_to").alias("r_to"), F.col("tags").alias("r_tags"), "need",
                     named.alias("named"), dated.alias("dated"), tagged.alias("tagged"))
    fits = ((F.coalesce(F.col("r_from"), F.lit(0)) == 0) | (F.col("year_founded") >= F.col("r_from"))) & \
           ((F.coalesce(F.col("r_to"), F.lit(0)) == 0) | (F.col("year_founded") <= F.col("r_to"))) & \
           (F.col("r_tags").isNull() | F.forall(F.col("r_tags"), lambda t: F.coalesce(F.array_contains(F.col("tags"), t), F.lit(False))))
    own, none = companies.columns, F.lit(None).cast("double").alias("score")
    rest = r.where(~F.col("named"))

    # equality criteria only: the first companies of each key, cut per key before they meet the requests
    keyed = companies.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(p).alias("r_pattern"), _company_key(p).alias("r_key"))
                                                             for p in patterns]))).select(*own, "_k.*")
    simple = rest.where(~F.col("dated") & ~F.col("tagged")).select("fs_id", "r_pattern", "r_key", "need")
    wk = Window.partitionBy("r_pattern", "r_key").orderBy(F.col("company_id").asc())
    wanted = keyed.join(bounded_broadcast(simple.select("r_pattern", "r_key").distinct(), max_broadcast_requests), ["r_pattern", "r_key"], "left_semi")
    heads = wanted.withColumn("_rk", F.row_number().over(wk)).where(F.col("_rk") <= F.lit(int(stats["plain_end"] or 0)))
    parts = [heads.join(bounded_broadcast(simple, max_broadcast_requests), ["r_pattern", "r_key"])
             .where(F.col("_rk") <= F.col("need")).select("fs_id", *own, none)]

    # tags: bitmaps of tags and equality criteria; without years only as many companies as the pages need
    if stats["tagged"]:
        facets = facets or build_facet_index(companies)
        values = F.split("r_key", "\u0001")
        equal = [F.when(F.col("r_pattern").bitwiseAND(F.lit(1 << i)) != 0, F.array(F.struct(F.lit(f).alias("facet"), values[i].alias("value"))))
                 .otherwise(F.array().cast("array<struct<facet:string,value:string>>")) for i, f in enumerate(EQ_FIELDS)]
        tags = F.transform(F.array_distinct("r_tags"), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
        by_tag = rest.where(F.col("tagged") & ~F.exists("r_tags", lambda t: t.isNull())).withColumn("facets", F.concat(tags, *equal))
        hits = facet_hits(facets, by_tag.select("fs_id", "facets", F.when(~F.col("dated"), F.col("need")).alias("need")), max_broadcast_requests)
        found = facets.numbered.join(hits, "pos").join(bounded_broadcast(by_tag.select("fs_id", "r_from", "r_to", "r_tags"), max_broadcast_requests), "fs_id")
        parts.append(found.where(fits).select("fs_id", *own, none))

    # years, alone or with equality criteria: the first companies of each founding year of each key, met year by year
    if stats["dated"]:
        by_year = rest.where(F.col("dated") & ~F.col("tagged")).select("fs_id", "r_pattern", "r_key", "r_from", "r_to", "need")
        wanted = keyed.join(bounded_broadcast(by_year.select("r_pattern", "r_key").distinct(), max_broadcast_requests), ["r_pattern", "r_key"], "left_semi")
        years = companies.agg(F.sort_array(F.collect_set("year_founded"))).first()[0]  # the years that occur; the smallest may be 0, the ingester's unknown year
        occurring = F.from_json(F.lit(json.dumps(years)), "array<int>")
        wy = Window.partitionBy("r_pattern", "r_key", "year_founded").orderBy(F.col("company_id").asc())
        heads = wanted.where(F.col("year_founded").isNotNull()).withColumn("_rk", F.row_number().over(wy)).where(F.col("_rk") <= F.lit(int(stats["years_end"])))
        lo, hi = (F.nullif(F.col(c), F.lit(0)) for c in ("r_from", "r_to"))
        inside = F.filter(occurring, lambda y: F.coalesce(y >= lo, F.lit(True)) & F.coalesce(y <= hi, F.lit(True)))
        by_year = by_year.select("fs_id", "r_pattern", "r_key", "need", F.explode(inside).alias("year_founded"))
        parts.append(by_year.join(heads, ["r_pattern", "r_key", "year_founded"]).where(F.col("_rk") <= F.col("need")).select("fs_id", *own, none))

    # names: from the hits of the index to their companies
    if stats["named"]:
        idx = index or name_index(companies, materialize=True)
        asked = r.where(F.col("named"))
        hits = (bm25(idx, asked.select(F.col("fs_id").alias("query_id"), F.col("r_name").alias("query")))
                .select(F.col("query_id").alias("fs_id"), F.col("doc_id").alias("company_id"), F.round("score", 6).alias("score")))
        met = hits.join(companies, "company_id").join(bounded_broadcast(asked, max_broadcast_requests), "fs_id").where(fits)
        same_key = reduce(lambda x, y: x | y, [(F.col("r_pattern") == p) & (F.col("r_key") == _company_key(p)) for p in patterns])
        parts.append(met.where(same_key).select("fs_id", *own, "score"))
    hits = reduce(DataFrame.unionByName, parts)
    wf = Window.partitionBy("fs_id").orderBy(F.col("score").desc_nulls_last(), F.col("company_id").asc())
    ranked = hits.withColumn("_rn", F.row_number().over(wf)).where(F.col("_rn") <= F.lit(max_end))
    back = req.select("request_id", "fs_id", "page", "size")
    out = ranked.join(bounded_broadcast(back, max_broadcast_requests), "fs_id")
    off = (F.col("page") - 1) * F.col("size")
    page = out.where((F.col("_rn") > off) & (F.col("_rn") <= off + F.col("size")))
    return page.withColumn("rank", (F.col("_rn") - off).cast("int")).drop(
        "_rn", "page", "size", "fs_id")


def deterministic_responses(requests: DataFrame, found: DataFrame) -> DataFrame:
    """The whole responses of structured searches: ``(request_id, results, diagnostics)``, one for every request.

    ``found`` is ``batch_search``'s answer. ``results`` holds the page in rank order (the company's columns but its vector,
    no score; empty where nothing matched), at most a page's size a request; ``diagnostics`` the route, an
    empty intent and no scores."""
    fields = [c for c in found.columns if c not in ("request_id", "rank", "score", "embedding")]
    item = F.struct("rank", *[F.col(f"`{c}`") for c in fields])
    pages = (found.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
             .select("request_id", F.transform("c", lambda x: x.dropFields("rank")).alias("results")))
    empty = F.array().cast(pages.schema["results"].dataType)
    diagnostics = F.struct(F.lit("Deterministic").alias("route"), F.create_map().cast("map<string,string>").alias("intent"),
                           F.array().cast("array<struct<company_id:string,name:string,re_rank_score:double,knn_score:double>>").alias("scores"))
    return (requests.select("request_id").join(pages, "request_id", "left")
            .select("request_id", F.coalesce("results", empty).alias("results"), diagnostics.alias("diagnostics")))
