"""Query intelligence: intent, related questions, competitors, topic gaps, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import attach_by_key, explode_rows
from siteglass.functions.text import each, let
from siteglass.operators.answers import USABLE
from siteglass.operators.components import connected_components
from siteglass.operators.similarity import paired_by_key
from siteglass.operators.substring_join import contained_in
from siteglass.session import cut_lineage

# Intents in priority order with their query words.
INTENT_WORDS = {
    "navigational": ["登录", "官网", "登陆", "login", "sign in", "register", "注册"],
    "transactional": [
        "买", "购买", "价格", "报价", "优惠", "打折", "折扣", "下单", "订单",
        "buy", "price", "deal", "coupon", "discount", "order", "cheap",
    ],
    "local": ["附近", "就近", "在哪", "地址", "营业时间", "电话", "near me", "nearby", "address", "directions", "hours"],
    "comparative": [
        "vs", "对比", "比较", "区别", "哪个好", "哪个更好", "评测", "compare", "comparison", "difference", "versus", "best",
    ],
    "informational": [
        "怎么", "如何", "为什么", "是什么", "什么是", "成因", "原理", "how to", "how do", "how does", "why", "what is", "what are",
        "guide", "教程", "意思",
    ],
}
# Domain fragments and question words.
SHOPPING = ["taobao", "tmall", "jd.com", "pinduoduo", "amazon", "shop", "shopee"]
LOCAL = ["dianping", "meituan", "map.baidu", "amap", "google.maps", "yelp"]
QUESTION_START = "^(怎么|如何|为什么|是什么|什么是)"
QUESTION_WORDS = [
    "怎么", "如何", "为什么", "是什么", "什么是", "成因", "原理", "哪个", "哪款", "哪种", "哪里", "在哪", "多少", "多久", "多快", "多远",
]
STOP_WORDS = [
    "的", "了", "是", "在", "和", "与", "或", "及", "如何", "怎么", "为什么", "是什么", "什么是", "哪个", "哪款", "一个", "可以", "能够", "应该", "需要",
    "best", "the", "a", "an", "of", "to", "for", "and", "or", "vs", "对比", "比较", "区别", "买", "价格", "优惠", "官网", "登录",
]
TITLE_BREAK = f"[{X.BLANK}\\-—·,，。：:、|｜()（）\\[\\]【】{{}}\"'`]+"


def query_intent(queries: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Intent by priority over word rules and result-page features; confidence from the number of hits.

    A query may be a whole text: it is lowered once and searched once for each word.
    """
    searched = let("lower(trim(query))", lambda q: "array(" + ", ".join(f"cast({X.contains_any(q, words)} AS int)" for words in INTENT_WORDS.values()) + ")")
    base = queries.select("query").distinct().withColumn("_words", F.expr(searched))
    features = ["_own", "_shop", "_map", "_ask"]
    if items is None:
        base = base.selectExpr("query", "_words", *[f"false AS {f}" for f in features])
    else:
        found = items.groupBy("query").agg(
            F.expr("bool_or(position = 1 AND owned)").alias("_own"),
            F.expr(f"bool_or({X.contains_any('domain', SHOPPING)})").alias("_shop"),
            F.expr(f"bool_or({X.contains_any('domain', LOCAL)})").alias("_map"),
            F.expr(f"bool_or({X.contains_any('title', ['?', '？'])} OR {X.matches('title', QUESTION_START)})").alias("_ask"),
        )
        base = base.join(found, "query", "left").na.fill(False, features)
    feature = {"navigational": "_own", "transactional": "_shop", "local": "_map", "informational": "_ask"}
    order = list(INTENT_WORDS)
    hits = {n: f"(_words[{i}] + cast({feature.get(n, 'false')} AS int))" for i, n in enumerate(order)}
    chosen = "CASE " + " ".join(f"WHEN {hits[n]} > 0 THEN '{n}'" for n in order) + " ELSE 'informational' END"
    total = " + ".join(hits.values())
    return base.selectExpr(
        "query", f"{chosen} AS intent", f"CASE WHEN {total} >= 2 THEN 'high' WHEN {total} = 1 THEN 'medium' ELSE 'low' END AS confidence"
    )


def _is_question(value: str) -> str:
    return X.contains_any(value, ["?", "？", *QUESTION_WORDS])


def related_questions(items: DataFrame, records: DataFrame) -> DataFrame:
    """Question-like titles and answer sentences with their distinct sources counted, per query."""
    # Question words hold no blanks, so texts without any are left out before the others are trimmed.
    asked = items.where(F.expr(_is_question("title")))
    titles = asked.selectExpr("query", f"{X.trim_blank('title')} AS question", "concat('serp:', engine, ':pos=', position) AS source")
    asking = X.keep("split(answer, '[。！!？?;\\n]', -1)", _is_question)
    sentences = X.keep(each(asking, X.trim_blank), lambda s: f"length({s}) BETWEEN 4 AND 199")
    spoken = explode_rows(records.where(USABLE), sentences, "question", "query", "model").selectExpr(
        "query", "question", "concat('ai:', model, ':answer') AS source"
    )
    return titles.unionByName(spoken).distinct().groupBy("query", "question").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"))


def query_competitors(items: DataFrame, records: DataFrame, own_domain: str | None = None) -> DataFrame:
    """Per query and domain: result pages and distinct positions, answers citing it, and where it was seen."""
    # First item of a domain on each result page.
    first = items.where("domain <> ''").groupBy("query", "engine", F.lower("domain").alias("domain")).agg(F.min("position").alias("position"))
    shown = first.groupBy("query", "domain").agg(
        F.count("*").alias("pages"), F.count_distinct("position").alias("positions"), F.min("position").alias("best_position")
    )
    domains = f"array_distinct({each('citations', lambda c: f'lower({U.registrable_domain(f'{c}.url')})')})"
    cited = explode_rows(records.where(USABLE), domains, "domain", "query").where("domain <> ''")
    cited = cited.groupBy("query", "domain").agg(F.count("*").alias("answers"))
    joined = shown.join(cited, ["query", "domain"], "full_outer")
    if own_domain:
        joined = joined.where(F.expr(f"domain <> lower({U.registrable_domain(X.lit(own_domain))})"))
    zero = "cast(0 AS bigint)"
    return joined.selectExpr(
        "query", "domain", f"coalesce(pages, {zero}) AS pages", f"coalesce(positions, {zero}) AS positions", "best_position",
        f"coalesce(answers, {zero}) AS answers",
        "CASE WHEN pages IS NOT NULL AND answers IS NOT NULL THEN 'both' WHEN pages IS NOT NULL THEN 'serp' ELSE 'ai' END AS source",
    )


def topic_gap(items: DataFrame, own_titles: DataFrame, own_domain: str | None = None, first: int | None = None) -> DataFrame:
    """Title topics (with `first`, only so many of a title) of at least two competitor domains that the own titles cover not at all or only in part, per query."""
    tokens = X.keep(
        each(f"split(title, {X.lit(TITLE_BREAK)}, -1)", lambda w: f"trim({w})"),
        lambda w: f"length({w}) BETWEEN 2 AND 12 AND lower({w}) NOT IN ({X.lits(STOP_WORDS)})",
    )
    rivals = items if own_domain is None else items.where(F.expr(f"domain <> {X.lit(own_domain)}"))
    kept = tokens if first is None else f"slice({tokens}, 1, {first})"
    pairs = rivals.select("query", "title", "domain").distinct()
    # A title is cut once per query; a topic of one title only is covered by that title's domains.
    titles = cut_lineage(pairs.groupBy("query", "title").agg(F.count("*").alias("domains")))
    topics = explode_rows(titles, f"array_distinct({kept})", "topic", "query", "title", "domains")
    counts = cut_lineage(topics.groupBy("query", "topic").agg(F.count("*").alias("titles"), F.sum("domains").alias("covered")).where("covered >= 2"))
    covered = counts.where("titles = 1").select("query", "topic", "covered")
    shared = counts.where("titles > 1").selectExpr("query AS _query", "topic AS _topic")
    if not shared.isEmpty():  # the same domain may stand under several titles
        held = topics.join(shared, F.expr("query <=> _query AND topic = _topic"), "left_semi").selectExpr("query AS _query", "title AS _title", "topic")
        met = pairs.join(cut_lineage(held), F.expr("query <=> _query AND title = _title")).select("query", "topic", "domain").distinct()
        covered = cut_lineage(covered.unionByName(met.groupBy("query", "topic").agg(F.count("*").alias("covered")).where("covered >= 2")))
    wanted = covered.selectExpr("lower(topic) AS needle").distinct()
    held = contained_in(wanted, own_titles.selectExpr("lower(title) AS hay").where("hay <> ''").distinct()).select("needle").distinct()
    joined = covered.withColumn("needle", F.lower("topic")).join(held.withColumn("_held", F.lit(True)), "needle", "left")
    coverage = "CASE WHEN _held IS NULL THEN 'none' WHEN covered >= 3 THEN 'partial' ELSE 'full' END"
    return joined.selectExpr("query", "topic", "covered", f"{coverage} AS own_coverage").where("own_coverage <> 'full'")


#: URLs of up to this many queries have their pairs of queries counted straight away.
LIGHT = 200


def query_overlap(results: DataFrame, min_jaccard: float = 0.3, min_shared: int = 2, light: int = LIGHT) -> DataFrame:
    """Pairs of queries by shared result URLs: Jaccard at least `min_jaccard`, or at least `min_shared` URLs.

    results: query, url. URLs of up to `light` queries give their pairs once, and a pair's URLs are counted from them. A
    pair that qualifies shares at least least(min_shared, ceil(min_jaccard * n)) URLs of either query, so of the more
    frequent URLs a query leaves out all but that many less one, its most frequent ones; for the pairs found the few left
    out are looked up. Nothing else is looked up again, and a list is no longer than `light`.
    """
    links = cut_lineage(results.select("query", "url").where("url <> ''").distinct())
    sizes = links.groupBy("query").agg(F.count("*").alias("n"))
    frequency = links.groupBy("url").agg(F.count("*").alias("df")).where("df > 1")
    # A URL of one query is in no pair; the sizes are counted with it.
    shared = attach_by_key(links, frequency, ["url"], "df", F.col("query")).where("df > 1")
    rows = cut_lineage(attach_by_key(shared, sizes, ["query"], "n", F.col("url")))
    needed = f"greatest(1, least({min_shared}, cast(ceil(n * {min_jaccard}D - 1e-9D) AS int)))"
    ranked = rows.where(f"df > {light}").withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("df"), "url")))
    heavy = cut_lineage(ranked.selectExpr("query", "url", "n", f"_n < {needed} AS _out"))

    listed = rows.where(f"df <= {light}").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("query", "n"))).alias("q"))
    pair = "named_struct('a', x.query, 'b', y.query, 'n_a', x.n, 'n_b', y.n)"
    every = f"flatten(transform(q, (x, i) -> transform(slice(q, i + 2, size(q)), y -> {pair})))"
    few = listed.select(F.explode(F.expr(every)).alias("p")).select("p.*")
    swap = lambda x, y: f"CASE WHEN a_query < b_query THEN {x} ELSE {y} END"
    many = paired_by_key(heavy.where("NOT _out"), "url", "query", ("n",)).selectExpr(
        "least(a_query, b_query) AS a", "greatest(a_query, b_query) AS b", f"{swap('a_n', 'b_n')} AS n_a", f"{swap('b_n', 'a_n')} AS n_b"
    )
    key = ["a", "b", "n_a", "n_b"]
    counted = few.unionByName(many).groupBy(*key).agg(F.count("*").alias("shared"))
    out = heavy.where("_out").select("query", "url")
    if not out.isEmpty():
        counted = cut_lineage(counted)
        sides = [counted.join(out.withColumnRenamed("query", own), own).join(heavy.selectExpr(f"query AS {other}", "url"), [other, "url"], "left_semi") for own, other in (("a", "b"), ("b", "a"))]
        more = sides[0].select(*key, "url").union(sides[1].select(*key, "url")).distinct().groupBy(*key).agg(F.count("*").alias("shared"))
        counted = counted.unionByName(more).groupBy(*key).agg(F.sum("shared").alias("shared"))
    scored = counted.withColumn("jaccard", F.expr("shared / (n_a + n_b - shared)"))
    return scored.where(f"jaccard >= {min_jaccard}D OR shared >= {min_shared}")


def query_clusters(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: cluster, query), (clusters: cluster, queries, mean overlap of its pairs to three decimals)."""
    pairs = cut_lineage(pairs)
    members = connected_components(pairs).selectExpr("component AS cluster", "node AS query")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("queries"))
    overlap = pairs.join(members.selectExpr("query AS a", "cluster"), "a").groupBy("cluster").agg(F.avg("jaccard").alias("_mean"))
    clusters = sizes.join(overlap, "cluster").selectExpr("cluster", "queries", "round(_mean, 3) AS overlap")
    return members, clusters


def cluster_urls(members: DataFrame, results: DataFrame, k: int = 20) -> DataFrame:
    """Up to k URLs shared within each cluster, most shared first."""
    rows = results.select("query", "url").distinct().join(members, "query").groupBy("cluster", "url").agg(F.count("*").alias("queries"))
    order = Window.partitionBy("cluster").orderBy(F.desc("queries"), "url")
    return rows.where("queries > 1").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def source_availability(queries: DataFrame, **sources: DataFrame) -> DataFrame:
    """Which inputs have rows for each query."""
    out = queries.select("query").distinct()
    for name, rows in sources.items():
        flagged = rows.select("query").distinct().withColumn(name, F.lit(True))
        out = out.join(flagged, "query", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def query_profile(intents: DataFrame, questions: DataFrame, competitors: DataFrame, gaps: DataFrame, available: DataFrame) -> DataFrame:
    """One row per query: intent with the number of questions, competitors and topic gaps, and the source flags."""
    out = intents
    for name, rows in {"questions": questions, "competitors": competitors, "topic_gaps": gaps}.items():
        out = out.join(rows.groupBy("query").agg(F.count("*").alias(name)), "query", "left")
    return out.na.fill(0, ["questions", "competitors", "topic_gaps"]).join(available, "query", "left")
