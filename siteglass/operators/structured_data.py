"""Structured-data diagnosis: visible page facts, page type, field completeness, consistency, entity clarity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteglass.functions import html as H
from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import explode_rows, fence
from siteglass.functions.text import BLANK, Sql, each, keep, let, some
from siteglass.operators import jsonld as J
from siteglass.operators import page_extract as P

# Visible-fact patterns.
QUESTION = "[?？]$|^(什么是|如何|怎么|怎样|为什么|是否|能否|多少|哪些|哪里|如何选择)"
STEP_HEADING = f"(?i)^(步骤[{BLANK}]*\\d+|第[一二三四五六七八九十\\d]+步|step[{BLANK}]*\\d+)"
STEP_NUMBER = f"^\\d+[.、)][{BLANK}]*[^{BLANK}]"
SOCIAL_HOST = (
    "(?i)(?:^|\\.)(linkedin\\.com|facebook\\.com|twitter\\.com|x\\.com|weibo\\.com|github\\.com|zhihu\\.com|wikipedia\\.org|"
    "instagram\\.com|youtube\\.com|douyin\\.com|bilibili\\.com)$"
)
PRICE = "(?:[¥￥$€£]\\s?)(\\d[\\d,]*(?:\\.\\d{1,2})?)|(\\d[\\d,]*(?:\\.\\d{1,2})?)\\s?(元|CNY|RMB|USD|EUR|GBP)"
PAGE_DATE = f"(20\\d{{2}})[{BLANK}]*[-/年.][{BLANK}]*(\\d{{1,2}})[{BLANK}]*[-/月.][{BLANK}]*(\\d{{1,2}})"
BUY_ACTION = "(?i)加入购物车|立即购买|立即抢购|马上购买|去结算|buy\\s*now|add\\s*to\\s*cart|checkout"
ADDRESS = f"(?i)(?:地址|Address)[{BLANK}]*[:：][{BLANK}]*(.{{4,80}})"
ABOUT_PATH = "(?i)(about|contact|guan-yu|lian-xi|guanyu|lianxi)"
ABOUT_TITLE = "(?i)关于我们|联系我们|关于公司|About\\s+Us|Contact\\s+Us"

# Page types in order of precedence, with the root types that prove them.
TYPE_ORDER = ["faq", "howto", "product", "local-business", "article", "organization", "website", "unknown"]
CONTENT_ROOTS = {
    "faq": "(?i)FAQPage|QAPage",
    "howto": "(?i)HowTo|Recipe",
    "product": "(?i)^(Product|ProductGroup|ProductModel|IndividualProduct|Vehicle|OfferCatalog)$",
    "local-business": "(?i)(LocalBusiness|Restaurant|FoodEstablishment|CafeOrCoffeeShop|Store|ProfessionalService|"
    "AutomotiveBusiness|LodgingBusiness|FinancialService|LegalService|MedicalBusiness|HealthAndBeautyBusiness|"
    "HomeAndConstructionBusiness|EmergencyService|TravelAgency|RealEstateAgent|TouristInformationCenter)$",
    "article": "(?i)(Article|BlogPosting|NewsArticle|TechArticle|Report|WebPageElement)",
}
ORGANISATION_ROOT = (
    "(?i)^(Organization|NGO|Corporation|EducationalOrganization|GovernmentOrganization|PerformingGroup)$"
)
WEBSITE_ROOT = "(?i)^WebSite$"

# Required and recommended fields per page type, and the node types they are read from.
FIELD_NODES = {
    "article": "(?i)Article|BlogPosting|NewsArticle|TechArticle|Report",
    "product": "(?i)^(Product|ProductGroup|ProductModel)$",
    "faq": "(?i)FAQPage|QAPage",
    "howto": "(?i)HowTo",
    "local-business": "(?i)LocalBusiness|Restaurant|Store|ProfessionalService",
    "organization": "(?i)Organization|NGO|Corporation",
    "website": "(?i)^WebSite$",
}
REQUIRED_FIELDS = {
    "article": ["headline", "datePublished"],
    "product": ["name"],
    "faq": ["mainEntity"],
    "howto": ["name", "step"],
    "local-business": ["name", "address"],
    "organization": ["name", "url"],
    "website": ["name", "url"],
}
RECOMMENDED_FIELDS = {
    "article": ["author.name", "publisher.name", "dateModified", "image", "mainEntityOfPage", "description"],
    "product": [
        "image", "description", "brand.name", "offers.price", "offers.priceCurrency", "offers.availability", "sku",
        "aggregateRating.ratingValue",
    ],
    "faq": ["mainEntity[].name", "mainEntity[].acceptedAnswer.text"],
    "howto": ["step[].text", "totalTime", "description", "tool"],
    "local-business": ["telephone", "openingHours", "address.streetAddress", "address.addressLocality", "url", "geo"],
    "organization": ["logo", "sameAs", "contactPoint.telephone", "contactPoint.email", "address"],
    "website": ["potentialAction", "description"],
}


def day_of(raw: Sql) -> Sql:
    """A date in any common spelling as YYYY-MM-DD, or null."""
    parts = f"filter(array({', '.join(X.extract(raw, PAGE_DATE, g) for g in (1, 2, 3))}), p -> p <> '')"
    spelled = let(parts, lambda p: f"CASE WHEN size({p}) = 3 THEN concat({p}[0], '-', lpad({p}[1], 2, '0'), '-', lpad({p}[2], 2, '0')) END")
    return f"coalesce(date_format({X.timestamp_of(raw)}, 'yyyy-MM-dd'), {spelled})"


def _currency(sign: Sql, word: Sql) -> Sql:
    return (
        f"CASE WHEN {sign} IN ('¥', '￥') OR {word} IN ('元', 'CNY', 'RMB') THEN 'CNY' WHEN {sign} = '$' OR {word} = 'USD' THEN 'USD' "
        f"WHEN {sign} = '€' OR {word} = 'EUR' THEN 'EUR' WHEN {sign} = '£' OR {word} = 'GBP' THEN 'GBP' END"
    )


def _visible_prices() -> Sql:
    def entry(m: Sql) -> Sql:
        value = f"concat({X.extract(m, PRICE, 1)}, {X.extract(m, PRICE, 2)})"
        currency = _currency(X.extract(m, "[¥￥$€£]", 0), X.extract(m, PRICE, 3))
        return f"named_struct('raw', {m}, 'value', replace({value}, ',', ''), 'currency', {currency})"

    return each(X.extract_all("text", PRICE), entry)


_PRICE_TAG = f"(?is)<(meta|span|div|ins|bdi)(?=[\\s/>]){H.ATTRIBUTES}>(?=(.*?)(?:</\\1\\s*>|\\z))"
_CURRENCY_TAG = "(?i)itemprop=[\"']priceCurrency[\"'][^>]*content=[\"']([^\"']+)[\"']"


def _marked_prices() -> Sql:
    """Prices of itemprop tags; the currency tag is looked for around the price tag."""
    tags = (
        f"zip_with({X.extract_all('html', _PRICE_TAG, 0)}, {X.extract_all('html', _PRICE_TAG, 3)}, "
        "(tag, content) -> named_struct('tag', tag, 'content', content))"
    )
    attrs = lambda t: X.extract(f"{t}.tag", f"(?is)^<[a-z]+{H.ATTRIBUTES}>", 1)
    priced = keep(
        tags,
        lambda t: let(
            f"coalesce({H.attribute(attrs(t), 'itemprop')}, '')",
            lambda i: f"{X.matches(i, '(?i)price')} AND NOT {X.matches(i, '(?i)pricecurrency')}",
        ),
    )

    def entry(t: Sql) -> Sql:
        value = f"coalesce({H.attribute(attrs(t), 'content')}, {X.strip_tags(f'{t}.content')})"
        around = f"substring(html, greatest(1, instr(html, {t}.tag) - 2000), 2500)"
        nearby = f"nullif({X.extract(around, _CURRENCY_TAG, 1)}, '')"
        return let(
            value,
            lambda v: f"named_struct('raw', {v}, 'value', {X.replaced(v, '[^\\d.,]', '')}, 'currency', coalesce({nearby}, "
            f"CASE WHEN {X.matches(v, '¥|￥|元')} THEN 'CNY' WHEN contains({v}, '$') THEN 'USD' END))",
        )

    return keep(each(priced, entry), lambda p: f"{p}.raw <> ''")


def _question_answers(most: int | None = None) -> Sql:
    """array<struct<question, answer>>: question headings with the text up to the next question heading.

    Each piece between headings is put into one answer only, so the work grows with the page. `most` cuts answers to so
    many characters.
    """
    heading = H.element_pattern("h[1-6]")
    listed = X.extract_all("html", heading)
    gaps = f"split(html, {X.lit(heading)}, -1)"

    def pairs(c: Sql) -> Sql:
        # c: struct<h: heading texts, full: heading elements, gap: pieces between>; q: positions of question headings
        positions = f"filter(sequence(0, size({c}.h)), i -> i < size({c}.h) AND {X.matches(f'get({c}.h, i)', QUESTION)})"
        first, after = "get(q, k)", f"coalesce(get(q, k + 1), size({c}.h))"
        later = f"{after} - {first} - 1"  # headings inside the answer
        inside = f"zip_with(slice({c}.full, {first} + 2, {later}), slice({c}.gap, {first} + 3, {later}), (f, g) -> concat(f, g))"
        text = X.strip_tags(f"concat(get({c}.gap, {first} + 1), array_join({inside}, ''))")
        answer = text if most is None else f"substring({text}, 1, {most})"
        answers = f"transform(sequence(0, size(q) - 1), k -> named_struct('question', get({c}.h, {first}), 'answer', {answer}))"
        body = f"CASE WHEN size(q) >= 2 THEN filter({answers}, a -> length(a.answer) >= 4) ELSE array() END"
        return f"element_at(transform(array({positions}), q -> {body}), 1)"

    texts = each(listed, lambda m: X.strip_tags(X.extract(m, heading, 3)))
    return let(f"named_struct('h', {texts}, 'full', {listed}, 'gap', {gaps})", pairs)


def _steps() -> Sql:
    """Items of the first ordered list, else step headings; each only when there are at least two."""
    first = X.extract("html", H.element_pattern("ol"), 3)
    items = keep(
        each(X.extract_all(first, H.element_pattern("li"), 3), X.strip_tags), lambda t: f"{t} <> ''"
    )
    heads = keep(
        each("doc_headings", lambda h: f"{h}.text"), lambda t: f"{X.matches(t, STEP_HEADING)} OR {X.matches(t, STEP_NUMBER)}"
    )
    return let(
        items,
        lambda i: let(heads, lambda h: f"CASE WHEN size({i}) >= 2 THEN {i} WHEN size({h}) >= 2 THEN {h} ELSE {J.NO_TEXT} END"),
    )


def with_schema_facts(pages: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Page facts plus typed nodes and the visible facts used for diagnosis."""
    df = P.with_page_facts(pages, as_of)
    df = J.with_root_types(J.with_nodes(df))
    headings = each(
        H.elements("html", "h[1-6]"),
        lambda e: f"named_struct('level', cast(substring({e}.name, 2, 1) AS int), 'text', {X.strip_tags(f'{e}.content')})",
    )
    contact = lambda scheme: keep(
        each(
            "anchors",
            lambda a: f"try_url_decode(replace(trim({X.extract(f'coalesce({a}.href, \'\')', f'(?i)^{scheme}:[{BLANK}]*([^?]+)')}), '+', '%2B'))",
        ),
        lambda v: f"{v} <> ''",
    )
    social = keep(
        "anchors",
        lambda a: f"coalesce({X.matches(f'{a}.href', U.ABSOLUTE)} AND ({X.matches(U.host_of(f'{a}.href'), SOCIAL_HOST)} "
        f"OR coalesce({X.matches(f'{a}.rel', '(?i)\\bme\\b')}, false)), false)",
    )
    hints = each(X.extract_all("text", ADDRESS, 1), lambda m: f"trim(split(trim({m}), '[\\n。；;]', 2)[0])")
    dates = each(
        X.extract_all("text", PAGE_DATE),
        lambda m: f"concat({X.extract(m, PAGE_DATE, 1)}, '-', lpad({X.extract(m, PAGE_DATE, 2)}, 2, '0'), '-', "
        f"lpad({X.extract(m, PAGE_DATE, 3)}, 2, '0'))",
    )
    tagged = lambda t, key: f"coalesce({H.attribute(f'{t}.attrs', key)}, '')"
    forms = some(
        H.named("tags", "form"),
        lambda t: f"{X.matches(tagged(t, 'action'), '(?i)search')} OR {X.matches(tagged(t, 'role'), '(?i)search')} "
        f"OR {X.matches(tagged(t, 'name'), '(?i)\\b(s|q|query|keyword)\\b')}",
    )
    columns = {
        "doc_headings": keep(headings, lambda h: f"{h}.text <> ''"),
        "mailto": f"array_distinct({contact('mailto')})",
        "tel": f"array_distinct({each(contact('tel'), lambda v: X.replaced(v, f'[{BLANK}-]', ''))})",
        "social_links": f"array_distinct({each(social, lambda a: f'{a}.href')})",
        "address_hints": f"array_distinct({keep(hints, lambda v: f'{v} <> \'\'')})",
        "visible_dates": f"array_distinct({dates})",
        "published_date": day_of("published_raw"),
        "modified_date": day_of("modified_raw"),
        "qa_pairs": _question_answers(),
        "priced": f"concat({_marked_prices()}, {_visible_prices()})",
        "has_buy_action": X.matches("text", BUY_ACTION),
        "has_search_action": f"{forms} OR {X.matches('html', '(?i)/(search|q)\\b')}",
        "site_name": "nullif(try_element_at(meta, 'og:site_name'), '')",
        "og_image": "nullif(try_element_at(meta, 'og:image'), '')",
    }
    df = df.withColumns({name: F.expr(sql) for name, sql in columns.items()})
    # Prices are distinct by raw value and currency; the first spelling is kept.
    distinct = (
        "filter(transform(priced, (p, i) -> CASE WHEN exists(slice(priced, 1, i), o -> o.raw_key = p.raw_key) THEN NULL ELSE p END), "
        "p -> p IS NOT NULL)"
    )
    keyed = each(
        "priced",
        lambda p: f"named_struct('raw', {p}.raw, 'value', {p}.value, 'currency', {p}.currency, "
        f"'raw_key', concat({p}.value, '|', coalesce({p}.currency, '')))",
    )
    df = df.withColumn("priced", F.expr(keyed)).withColumn("prices", F.expr(distinct)).drop("priced")
    df = df.withColumns(
        {
            "h1": F.expr("try_element_at(filter(doc_headings, h -> h.level = 1), 1).text"),
            "steps": F.expr(_steps()),
        }
    )
    return fence(df)


def page_contacts(facts: DataFrame) -> DataFrame:
    """Long form: url, kind (mailto, tel, social, address), value."""
    kinds = {"mailto": "mailto", "tel": "tel", "social": "social_links", "address": "address_hints"}
    listed = ", ".join(f"transform({col}, v -> named_struct('kind', '{kind}', 'value', v))" for kind, col in kinds.items())
    return explode_rows(facts, f"concat({listed})", "c", "url").select("url", "c.kind", "c.value")


def page_dates(facts: DataFrame) -> DataFrame:
    return facts.select("url", "published_date", "modified_date", "visible_dates")


def page_qa_pairs(facts: DataFrame) -> DataFrame:
    return explode_rows(facts, "qa_pairs", "p", "url", position="ordinal").select("url", "ordinal", "p.question", "p.answer")


def page_steps(facts: DataFrame) -> DataFrame:
    return explode_rows(facts, "steps", "step", "url", position="ordinal")


def page_prices(facts: DataFrame) -> DataFrame:
    return explode_rows(facts, "prices", "p", "url").select("url", "p.raw", "p.value", "p.currency")


def page_actions(facts: DataFrame) -> DataFrame:
    return facts.select("url", "has_buy_action", "has_search_action")


def with_page_type(facts: DataFrame) -> DataFrame:
    """Add `page_type` and `type_confidence`: best candidate by confidence, then by type order."""

    def root(pattern: str) -> Sql:
        return some("root_types", lambda t: X.matches(t, pattern))

    content = {name: root(pattern) for name, pattern in CONTENT_ROOTS.items()}
    no_content = "NOT (" + " OR ".join(content.values()) + ")"
    path = "CASE WHEN url rlike '(?i)^https?://' THEN url ELSE concat('https://', url) END"
    contact = "(size(tel) > 0 OR size(mailto) > 0)"
    about = f"({X.matches(U.path_of(path), ABOUT_PATH)} OR coalesce({X.matches('title', ABOUT_TITLE)}, false)) AND {contact}"
    rules = {
        "faq": (content["faq"], "size(qa_pairs) >= 2", "false"),
        "howto": (content["howto"], "size(steps) >= 2", "false"),
        "product": (content["product"], "size(prices) > 0 AND has_buy_action", "size(prices) > 0"),
        "local-business": (
            content["local-business"], "size(tel) > 0 AND size(address_hints) > 0", "size(tel) > 0 OR size(address_hints) > 0",
        ),
        "article": (
            content["article"], "published_raw IS NOT NULL",
            "word_count >= 300 AND (author IS NOT NULL OR size(visible_dates) > 0)",
        ),
        "organization": (f"{no_content} AND {root(ORGANISATION_ROOT)}", "false", f"{no_content} AND {about}"),
        "website": (f"{no_content} AND {root(WEBSITE_ROOT)}", "false", f"{no_content} AND {U.path_of(path)} = '/'"),
    }
    candidates = ", ".join(
        f"named_struct('c', CASE WHEN {high} THEN 0 WHEN {medium} THEN 1 WHEN {low} THEN 2 END, 'o', {i}, 't', '{name}')"
        for i, (name, (high, medium, low)) in enumerate(rules.items())
    )
    best = f"array_min(filter(array({candidates}), x -> x.c IS NOT NULL))"
    df = facts.withColumn("_best", F.expr(best))
    df = df.withColumns(
        {
            "page_type": F.expr("coalesce(_best.t, 'unknown')"),
            "type_confidence": F.expr("CASE _best.c WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"),
        }
    )
    return fence(df.drop("_best"))


def page_type(typed: DataFrame) -> DataFrame:
    return typed.select("url", "page_type", "type_confidence")


def _first_of(v: Sql) -> Sql:
    """The value itself, or the first member when it is an array."""
    return let(v, lambda x: let(J.as_array(x), lambda a: f"CASE WHEN {a} IS NULL THEN {x} ELSE get({a}, 0) END"))


def _read(root: Sql, steps: Sql) -> Sql:
    """Follow keys from a variant, stepping into the first member of arrays."""
    return f"aggregate({steps}, {root}, (cur, k) -> {_first_of(f'try_element_at({J.as_object('cur')}, k)')})"


def _is_empty(v: Sql) -> Sql:
    return (
        f"({v} IS NULL OR is_variant_null({v}) OR coalesce(trim({J.as_text(v)}) = '', false) "
        f"OR coalesce(size({J.as_array(v)}) = 0, false) OR coalesce(size({J.as_object(v)}) = 0, false))"
    )


def _catalogue() -> Sql:
    """CASE page_type giving array<struct<path, level, head, list_key, rest>>."""
    cases = []
    for name in FIELD_NODES:
        entries = []
        for level, fields in (("required", REQUIRED_FIELDS[name]), ("recommended", RECOMMENDED_FIELDS[name])):
            for path in fields:
                before, bracket, after = path.partition("[]")
                steps = before.split(".")
                head = steps[:-1] if bracket else steps
                key = f"'{steps[-1]}'" if bracket else "cast(NULL AS string)"
                rest = [s for s in after.split(".") if s]
                arrays = [f"array({X.lits(p)})" if p else J.NO_TEXT for p in (head, rest)]
                entries.append(
                    f"named_struct('path', '{path}', 'level', '{level}', 'head', {arrays[0]}, 'list_key', {key}, 'rest', {arrays[1]})"
                )
        cases.append(f"WHEN '{name}' THEN array({', '.join(entries)})")
    return f"CASE page_type {' '.join(cases)} END"


def _target_node() -> Sql:
    cases = " ".join(
        f"WHEN '{name}' THEN try_element_at(filter(nodes, n -> {some('n.types', lambda t, p=pattern: X.matches(t, p))}), 1).node"
        for name, pattern in FIELD_NODES.items()
    )
    return f"CASE page_type {cases} END"


def _fields(typed: DataFrame, *keep_columns: str) -> DataFrame:
    """One row per page and catalogue field, with the target node as `root` and the read values."""
    df = typed.withColumn("root", F.expr(f"try_parse_json({_target_node()})"))
    rows = explode_rows(df, _catalogue(), "f", "url", "page_type", "root", *keep_columns)
    scalar = _read("root", "f.head")
    members = let(
        f"try_element_at({J.as_object(_read('root', 'f.head'))}, f.list_key)",
        lambda v: f"CASE WHEN {v} IS NULL THEN cast(array() AS array<variant>) ELSE coalesce({J.as_array(v)}, array({v})) END",
    )
    values = each(members, lambda m: _read(m, "f.rest"))
    return rows.withColumns(
        {
            "value": F.expr(f"CASE WHEN root IS NOT NULL AND f.list_key IS NULL THEN {scalar} END"),
            "values": F.expr(f"CASE WHEN root IS NOT NULL AND f.list_key IS NOT NULL THEN {values} END"),
        }
    )


def field_completeness(typed: DataFrame) -> DataFrame:
    """Status of every catalogue field: present, empty, missing, or incomplete for list fields."""
    rows = _fields(typed)
    filled = f"size({keep('values', lambda v: f'NOT {_is_empty(v)}')})"
    status = (
        "CASE WHEN root IS NULL THEN 'missing' "
        f"WHEN f.list_key IS NOT NULL THEN CASE WHEN size(values) = 0 THEN 'missing' WHEN {filled} = size(values) THEN 'present' ELSE 'incomplete' END "
        f"WHEN NOT {_is_empty('value')} THEN 'present' "
        f"WHEN is_variant_null(value) OR coalesce({J.as_text('value')} = '', false) THEN 'empty' ELSE 'missing' END"
    )
    return rows.selectExpr("url", "page_type", "f.path", "f.level", f"{status} AS status")


def schema_gap_counts(fields: DataFrame) -> DataFrame:
    """Missing required and recommended fields per page."""
    return fields.groupBy("url").agg(
        F.expr("count_if(level = 'required' AND status IN ('missing', 'empty'))").alias("missing_required"),
        F.expr("count_if(level = 'recommended' AND status IN ('missing', 'empty', 'incomplete'))").alias("missing_recommended"),
    )


def _norm(value: Sql) -> Sql:
    shortened = X.replaced(X.replaced(value, f"[{BLANK}]+", " "), f"[|｜·][{BLANK}]*[^|｜·]{{2,40}}$", "")
    return f"lower(trim({shortened}))"


def text_agrees(a: Sql, b: Sql) -> Sql:
    """Equal after normalising, or one inside the other with a length ratio of at least 0.6."""

    def verdict(p: Sql) -> Sql:
        ratio = f"least(length({p}.a), length({p}.b)) / greatest(length({p}.a), length({p}.b))"
        return (
            f"{p}.a <> '' AND {p}.b <> '' AND ({p}.a = {p}.b OR ({ratio} >= 0.6D AND "
            f"(contains({p}.a, {p}.b) OR contains({p}.b, {p}.a))))"
        )

    return let(f"named_struct('a', {_norm(a)}, 'b', {_norm(b)})", verdict)


def _text_at(root: Sql, *steps: str) -> Sql:
    """Trimmed non-blank text at a path, else null."""
    return f"nullif(trim({let(_read(root, f'array({X.lits(steps)})'), J.as_text)}), '')"


def schema_consistency(typed: DataFrame) -> DataFrame:
    """Where the structured data and the visible page disagree: url, kind, severity, both values."""
    df = typed.withColumn("root", F.expr(f"try_parse_json({_target_node()})"))
    df = df.withColumns(
        {
            "_headline": F.expr(f"coalesce({_text_at('root', 'headline')}, {_text_at('root', 'name')})"),
            "_day": F.expr(let(J.as_text("try_element_at(" + J.as_object("root") + ", 'datePublished')"), lambda t: f"date_format({X.timestamp_of(t)}, 'yyyy-MM-dd')")),
            "_author": F.expr(_text_at("root", "author", "name")),
            "_name": F.expr(_text_at("root", "name")),
            "_days": F.expr("filter(concat(array(published_date), visible_dates), d -> d IS NOT NULL)"),
            "_site": F.expr("coalesce(site_name, title)"),
        }
    )

    def issue(condition: Sql, kind: str, severity: str, left: Sql, right: Sql) -> Sql:
        return (
            f"CASE WHEN {condition} THEN named_struct('kind', '{kind}', 'severity', '{severity}', "
            f"'jsonld_value', {left}, 'page_value', {right}) END"
        )

    issues = ", ".join(
        [
            issue(
                f"_headline IS NOT NULL AND h1 IS NOT NULL AND NOT {text_agrees('_headline', 'h1')}",
                "headline-h1-mismatch", "mismatch", "_headline", "h1",
            ),
            issue(
                "_day IS NOT NULL AND size(_days) > 0 AND NOT array_contains(_days, _day)",
                "date-published-mismatch", "mismatch", "_day", "get(_days, 0)",
            ),
            issue(
                f"_author IS NOT NULL AND author IS NOT NULL AND NOT {text_agrees('_author', 'author')}",
                "author-mismatch", "suspect", "_author", "author",
            ),
            issue(
                f"page_type IN ('organization', 'website') AND _name IS NOT NULL AND _site IS NOT NULL AND NOT {text_agrees('_name', '_site')}",
                "title-mismatch", "suspect", "_name", "_site",
            ),
        ]
    )
    rows = explode_rows(df, f"filter(array({issues}), i -> i IS NOT NULL)", "i", "url", "page_type")
    return rows.select("url", "page_type", "i.*")


def entity_clarity(facts: DataFrame) -> DataFrame:
    """Long form: url, signal, present, value, source for author, organisation, profiles, contact and dates."""
    parsed = each("nodes", lambda n: f"named_struct('types', {n}.types, 'root', try_parse_json({n}.node))")
    df = facts.withColumn("_parsed", F.expr(parsed))

    def of_type(pattern: str) -> Sql:
        return keep("_parsed", lambda n: some(f"{n}.types", lambda t: X.matches(t, pattern)))

    def first(nodes: Sql, *steps: str) -> Sql:
        values = each(nodes, lambda n: _text_at(f"{n}.root", *steps))
        return f"try_element_at({keep(values, lambda v: f'{v} IS NOT NULL')}, 1)"

    articles = of_type("(?i)Article|BlogPosting|NewsArticle|TechArticle|Book|Recipe|HowTo")
    organisations = of_type("(?i)Organization|NGO|Corporation|LocalBusiness|Restaurant|Store")
    people = of_type("(?i)Person")
    profiles = keep(
        each(
            "_parsed",
            lambda n: f"size({keep(let(f'try_element_at({J.as_object(f'{n}.root')}, \'sameAs\')', lambda v: f'coalesce({each(J.as_array(v), J.as_text)}, {J.NO_TEXT})'), lambda t: X.filled(t))})",
        ),
        lambda s: f"{s} > 0",
    )
    ranked = {
        "author": [
            ("jsonld", f"coalesce({first(articles, 'author', 'name')}, {first(people, 'name')})"), ("meta", "author"),
        ],
        "organization": [
            ("jsonld", f"coalesce({first(organisations, 'name')}, {first('_parsed', 'publisher', 'name')})"), ("meta", "site_name"),
        ],
        "sameAs": [
            ("jsonld", f"cast(try_element_at({profiles}, 1) AS string)"),
            ("visible", "CASE WHEN size(social_links) > 0 THEN cast(size(social_links) AS string) END"),
        ],
        "contact": [
            (
                "jsonld",
                f"coalesce({first('_parsed', 'telephone')}, {first('_parsed', 'contactPoint', 'telephone')}, "
                f"{first('_parsed', 'contactPoint', 'email')})",
            ),
            ("visible", "coalesce(get(tel, 0), get(mailto, 0), get(address_hints, 0))"),
        ],
        "datePublished": [
            ("jsonld", first(articles, "datePublished")), ("meta", "coalesce(published_date, published_raw)"),
        ],
        "dateModified": [("jsonld", first(articles, "dateModified")), ("meta", "coalesce(modified_date, modified_raw)")],
    }
    entries = []
    for signal, options in ranked.items():
        picks = ", ".join(f"CASE WHEN {sql} IS NOT NULL THEN named_struct('value', {sql}, 'source', '{src}') END" for src, sql in options)
        entries.append(f"named_struct('signal', '{signal}', 'pick', coalesce({picks}))")
    rows = explode_rows(df, f"array({', '.join(entries)})", "e", "url")
    return rows.selectExpr("url", "e.signal", "e.pick IS NOT NULL AS present", "e.pick.value", "e.pick.source")


# Which visible fact can fill a field when the structured data lacks it.
_FILLS = {
    "article": {
        "headline": "coalesce(h1, title)", "description": "description", "image": "og_image",
        "datePublished": "coalesce(published_date, get(visible_dates, 0))", "dateModified": "modified_date",
        "mainEntityOfPage": "url", "author.name": "author", "publisher.name": "site_name",
    },
    "product": {
        "name": "coalesce(h1, title)", "description": "description", "image": "og_image",
        "offers.price": "try_element_at(filter(prices, p -> p.currency IS NOT NULL), 1).value",
        "offers.priceCurrency": "try_element_at(filter(prices, p -> p.currency IS NOT NULL), 1).currency",
    },
    "faq": {
        "mainEntity": "get(qa_pairs, 0).question", "mainEntity[].name": "get(qa_pairs, 0).question",
        "mainEntity[].acceptedAnswer.text": "get(qa_pairs, 0).answer",
    },
    "howto": {
        "name": "coalesce(h1, title)", "description": "description", "step": "get(steps, 0)", "step[].text": "get(steps, 0)",
    },
    "local-business": {
        "name": "coalesce(site_name, title)", "telephone": "get(tel, 0)", "url": "url",
        "address": "get(address_hints, 0)", "address.streetAddress": "get(address_hints, 0)",
    },
    "organization": {
        "name": "coalesce(site_name, title)", "url": "url", "logo": "og_image", "sameAs": "get(social_links, 0)",
        "contactPoint.telephone": "get(tel, 0)", "contactPoint.email": "get(mailto, 0)", "address": "get(address_hints, 0)",
    },
    "website": {"name": "coalesce(site_name, title)", "url": "url", "description": "description"},
}


def draft_coverage(typed: DataFrame) -> DataFrame:
    """Per page type and field: pages where the field is known from the page, and where a person must supply it."""
    cases = " ".join(
        f"WHEN page_type = '{name}' AND f.path = '{path}' THEN {sql}"
        for name, fills in _FILLS.items()
        for path, sql in fills.items()
    )
    columns = [
        "title", "h1", "description", "og_image", "published_date", "modified_date", "visible_dates", "author", "site_name",
        "prices", "qa_pairs", "steps", "tel", "mailto", "address_hints", "social_links",
    ]
    rows = _fields(typed, *columns)
    in_list = f"size(values) > 0 AND size({keep('values', lambda v: f'{v} IS NULL OR is_variant_null({v}) OR coalesce({J.as_text(v)} = \'\', false)')}) = 0"
    in_node = (
        f"CASE WHEN f.list_key IS NOT NULL THEN coalesce({in_list}, false) "
        f"ELSE coalesce(value IS NOT NULL AND NOT is_variant_null(value) AND coalesce({J.as_text('value')} <> '', true), false) END"
    )
    known = f"{in_node} OR (coalesce(size(values), 0) = 0 AND (CASE {cases} END) IS NOT NULL)"
    return (
        rows.selectExpr("page_type", "f.path", "f.level", f"{known} AS known")
        .groupBy("page_type", "path", "level")
        .agg(F.count("*").alias("pages"), F.count_if("known").alias("fillable"))
        .withColumn("manual", F.col("pages") - F.col("fillable"))
    )
