"""Stored web pages and report texts: main text, links, gates, and company names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Entities of HTML that texts commonly hold; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
# Phrases of pages that hide their content.
GATES = {
    "JS_REQUIRED": ["doesn't work properly without javascript", "enable javascript", "javascript is required", "请开启javascript", "请启用javascript"],
    "CAPTCHA_REQUIRED": ["captcha", "验证码", "滑块验证", "人机验证"],
    "LOGIN_REQUIRED": ["login required", "请登录", "登录后", "统一身份认证"],
}
BLOCK = r"(?i)</?(?:p|div|br|li|tr|h[1-4]|section|article)(?:\s[^>]*)?/?>"


def unescaped(text: Column) -> Column:
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def tidy(text: Column) -> Column:
    """Lines without blank ones, with single spaces."""
    t = F.regexp_replace(F.translate(text, " 　\r", "  \n"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n+", "\n"), F.lit("\n "))


def main_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block elements break lines, other tags vanish."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", "")
    return tidy(unescaped(F.regexp_replace(F.regexp_replace(t, BLOCK, "\n"), r"<[^>]+>", "")))


def title(html: Column) -> Column:
    return F.nullif(tidy(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def links(html: Column, url: Column) -> Column:
    """Different absolute links of anchors, in order; relative ones take the page's scheme and host."""
    root = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    full = F.transform(found, lambda h: F.when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(h))
    return F.array_distinct(F.filter(full, lambda h: h.rlike("^https?://")))


def attachments(urls: Column) -> Column:
    return F.filter(urls, lambda u: u.rlike(r"(?i)\.(pdf|docx?|xlsx?|zip)($|[?#])"))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, title, canonical_url, text, digest, quality, links, attachments) of pages."""
    t = main_text(F.col("html"))
    out = pages.select("page_id", title(F.col("html")).alias("title"), canonical_url(F.col("html"), F.col("url")).alias("canonical_url"), t.alias("text"),
        links(F.col("html"), F.col("url")).alias("links"))
    quality = F.when(F.length("text") >= 40, "good").when(F.col("text") != "", "partial").otherwise("failed")
    return out.select("*", F.sha2("text", 256).alias("text_sha256"), quality.alias("quality"), attachments(F.col("links")).alias("attachments"))


def gate(status: Column, html: Column) -> Column:
    """The access status of a stored page: 403, 404, then gates by scripts, captcha and login, else DOWNLOAD_OK."""
    text = F.lower(F.coalesce(html, F.lit("")))
    out = F.when(status == 403, "HTTP_403").when(status == 404, "HTTP_404")
    for name, words in GATES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise("DOWNLOAD_OK")


def domain(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.trim(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


# Suffixes of company names, the first that fits goes.
COMPANY_SUFFIXES = ["股份有限公司", "有限责任公司", "有限公司", "集团股份有限公司", "集团有限公司", "公司", "coltd", "limited", "ltd"]


def company_name(text: Column) -> Column:
    """A company's name in lower case without marks, spaces and its legal form."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s\u3000·•,，。.;；:：'\"()（）\[\]【】_-]+", "")
    out = F.when(F.lit(False), t)
    for suffix in COMPANY_SUFFIXES:
        out = out.when(F.endswith(t, F.lit(suffix)), F.substring(t, F.lit(1), F.length(t) - len(suffix)))
    return out.otherwise(t)


def canonical_url(html: Column, url: Column) -> Column:
    """The address that a page gives as its own; a relative one takes the page's scheme and host, none is null."""
    link = F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<link\s(?=[^>]*rel\s*=\s*["']?[^"'>]*canonical)[^>]*?href\s*=\s*["']([^"'>]+)["']""", 1)
    root = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.when(link == "", None).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(link)


def plain_label(text: Column) -> Column:
    """A row's label without spaces, numbering, words like 其中 and a colon at its end."""
    t = F.replace(F.translate(compact(text), "，", ","), F.lit(":"), F.lit("："))
    t = F.regexp_replace(F.regexp_replace(t, r"^[一二三四五六七八九十百]+、", ""), r"^\d+[.、]", "")
    for prefix in ("其中：", "加：", "减："):
        t = F.regexp_replace(t, f"^{prefix}", "")
    return F.regexp_replace(t, "：+$", "")


def label_matches(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (label, ...) joined to targets (alias, ...) whose alias is the label, or what stands before a bracket in it.

    An equi-join on the label and its beginnings before each bracket, of which there are a few.
    """
    label = plain_label(F.col("label"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("d__l"), F.lit(1))), lambda i: F.substring(F.col("d__l"), i, F.lit(1)).isin("（", "("))
    begins = F.transform(at, lambda i: F.substring(F.col("d__l"), F.lit(1), i - 1))
    marked = rows.withColumn("d__l", label).withColumn("d__k", F.explode(F.array_distinct(F.concat(F.array("d__l"), begins))))
    named = targets.withColumn("d__a", plain_label(F.col("alias"))).filter("d__a != ''")
    return marked.join(named, F.col("d__k") == F.col("d__a")).drop("d__l", "d__k", "d__a")


NUMBER = r"(-?\(\s*\d[\d,]*(?:\.\d+)?\s*\)|-?\d[\d,]*(?:\.\d+)?)"
# What a unit multiplies by.
UNITS = {"元": 1.0, "千元": 1e3, "万元": 1e4, "亿元": 1e8, "元/股": 1.0}


def _tokens(line: Column) -> Column:
    """(raw, value) of the amounts of a line, without numbers of notes: one or two digits in brackets."""
    found = F.regexp_extract_all(F.translate(line, "，（）−", ",()-"), F.lit(NUMBER), F.lit(1))
    amount = F.filter(found, lambda x: ~x.rlike(r"^\(\s*\d{1,2}\s*\)$"))
    number = lambda x: F.translate(x, "(), ", "").try_cast("double")
    value = lambda x: F.when(F.startswith(x, F.lit("(")), -F.abs(number(x))).otherwise(number(x))
    return F.transform(amount, lambda x: F.struct(x.alias("raw"), value(x).alias("value")))


def _once(value: Column, use) -> Column:
    """use(value), with the value calculated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def amounts(line: Column) -> Column:
    """Amounts of a line as numbers: full-width marks read as half-width, brackets make them negative, notes are left out."""
    return F.transform(_tokens(line), lambda x: x["value"])


def chosen(line: Column) -> Column:
    """(raw, value) of the first amount of a line that looks like one (100 or more, a mark or a bracket), else of its first."""
    return _once(_tokens(line), _chosen)


def _chosen(tokens: Column) -> Column:
    likely = F.filter(tokens, lambda x: (F.abs(x["value"]) >= 100) | x["raw"].rlike("[,.(]"))
    return F.coalesce(F.get(likely, 0), F.get(tokens, 0))


def page_unit(text: Column) -> Column:
    """The unit that a page states for its amounts; null if none."""
    found = F.regexp_extract(F.regexp_replace(text, r"[\s\u00a0\u3000]+", ""), r"(?:单位[：:]?|金额单位(?:为|[：:]))(?:人民币)?(亿元|万元|千元|元)", 1)
    return F.nullif(found, F.lit(""))


def row_unit(row: Column) -> Column:
    """The unit that a row states, 元/股 first; null if none."""
    t = F.regexp_replace(row, r"[\s\u00a0\u3000]+", "")
    own = F.nullif(F.regexp_extract(t, r"[（(](?:人民币)?(亿元|万元|千元|元)[）)]", 1), F.lit(""))
    return F.when(t.rlike(r"[（(](?:人民币)?元[/／]股[）)]"), "元/股").otherwise(F.coalesce(page_unit(row), own))


# What stands in a row besides its label: numbers, and how notes are referred to.
ANY_NUMBER = r"(?:[-−]?\(\s*\d+(?:[,，]\d{3})*(?:\.\d+)?\s*\)|[-−]?\d+(?:[,，]\d{3})*(?:\.\d+)?)"
NOTE_REFERENCE = r"[一二三四五六七八九十百]+(?:[（(]\d+(?:[-—]\d+)?[）)])+(?:[（(][A-Za-z][）)])?"


def label_context(row: Column) -> Column:
    """What is left of a row without numbers, references to notes, slashes, dashes and per cent."""
    t = F.regexp_replace(F.regexp_replace(row, NOTE_REFERENCE, " "), ANY_NUMBER, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[（(][A-Za-z][）)]", " "), r"(^|\s)[一二三四五六七八九十百]+(?=\s|$)", " ")
    t = F.regexp_replace(F.translate(F.regexp_replace(t, r"[/／]+", " "), "—–-%", "    "), r"[一二三四五六七八九十百]+$", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _label(row: Column) -> Column:
    return F.lower(plain_label(label_context(row)))


# What label_context() and plain_label() may take away or replace, but for letters in brackets.
REMOVABLE = " \t\n\x0b\f\r\u00a0\u30000123456789一二三四五六七八九十百()（）-−—–%/／,，.、:：其中加减"


def _bare(text: Column) -> Column:
    """A text without all that its label may lack; that of joined rows is theirs joined."""
    return F.translate(text, REMOVABLE, "")


def _folded(bare: Column) -> Column:
    return F.translate(F.lower(bare), "ς", "σ")  # in lower case the letter's form depends on what follows


def _could_match(windows: DataFrame, named: DataFrame) -> DataFrame:
    """The windows (d__bare, d__open, w) whose label can be that of a target (d__a, d__reach), or open with it before a bracket.

    All that labels keep of a text is there in its order, so a label's bare text begins the bare text of its window, and is
    the whole of it where there is no bracket. This spares most windows the making of their label.
    """
    bare = named.select(_folded(_bare(F.col("d__a"))).alias("d__t"), "d__reach")
    some = bare.agg(F.coalesce(F.max(F.col("d__t") == ""), F.lit(False)).alias("d__some"))  # one row
    keys = bare.withColumn("d__first", F.explode(F.array(F.substring("d__t", 1, 1), F.lit(""))))
    first = F.when(F.col("d__some"), "").otherwise(F.nullif(F.substring("d__bare", 1, 1), F.lit("")))
    asked = windows.crossJoin(F.broadcast(some)).withColumn("d__key", first)
    hit = F.startswith("d__bare", "d__t") & (F.col("d__open") | (F.col("d__bare") == F.col("d__t"))) & (F.col("w") <= F.col("d__reach"))
    return asked.join(F.broadcast(keys), (F.col("d__key") == F.col("d__first")) & hit, "left_semi").drop("d__bare", "d__open", "d__some", "d__key")


def _is_label(label: Column, alias: Column) -> Column:
    """Whether a row's label is the alias, or the alias and a bracket."""
    after = F.substr(label, F.length(alias) + 1, F.lit(1))
    return (label == alias) | F.startswith(label, alias) & after.isin("（", "(")


def scored(lines: DataFrame, targets: DataFrame, within: Column, width: int = 3, summary_width: int = 6) -> DataFrame:
    """The best amount for each target (statement, field_key) on each page: its score, context and where it stood.

    lines: document_id, page, line_no, line, and what `within`, the condition on a line and a target, needs. targets:
    field_key, label, statement, summary, semantics. Windows of one to `width` lines of a page (summary_width for a summary's
    own rows) are asked for their label: what is left of them without numbers and references to notes. A target whose label
    that is, or opens it before a bracket, takes an amount from one of the window's lines, or from what stands between its
    label and the next label of any target. An amount in the label's line scores highest, then one between the parts of a label,
    one before it and one after it; exact labels and short windows score more. Ties go to the earlier window and longer label.

    Labels are matched by an equi-join on the window's label and its beginnings before brackets, so a page costs its lines times
    summary_width, however many targets there are.
    """
    most = max(width, summary_width)
    carried = [c for c in lines.columns if c not in ("line_no", "line")]
    following = Window.partitionBy("document_id", "page").orderBy("line_no").rowsBetween(0, most - 1)
    # letters in brackets go from a label as from its rows
    row = F.struct("line_no", "line", _label(F.col("line")).alias("label"), _bare(F.regexp_replace("line", r"[（(][A-Za-z][）)]", "")).alias("bare"))
    starts = lines.withColumn("d__r", row).withColumn("d__all", F.collect_list("d__r").over(following)).drop("d__r", "line", "line_no")
    windows = starts.withColumn("w", F.explode(F.sequence(F.lit(1), F.size("d__all")))).withColumn("d__part", F.slice("d__all", F.lit(1), F.col("w"))).drop("d__all")
    named = targets.select("field_key", "label", F.col("statement").alias("d__of"), "summary", "semantics", F.lower(plain_label(F.col("label"))).alias("d__a"),
        F.when(F.col("summary"), summary_width).otherwise(width).alias("d__reach")).filter("d__a != ''")
    windows = windows.withColumn("context", F.array_join("d__part.line", " "))
    windows = windows.withColumns({"d__bare": _folded(F.array_join("d__part.bare", "")), "d__open": F.col("context").rlike("[（(]")})
    own = F.when(F.col("w") == 1, F.get("d__part", 0)["label"]).otherwise(_label(F.col("context")))
    # exploded, so that no filter makes it a second time
    windows = _could_match(windows, named).withColumn("d__l", F.explode_outer(F.array(own))).filter("d__l != ''").withColumn("start", F.get("d__part", 0)["line_no"])
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("d__l"), F.lit(1))), lambda i: F.substring(F.col("d__l"), i, F.lit(1)).isin("（", "("))
    begins = F.when(F.col("d__l").rlike("[（(]"), F.transform(at, lambda i: F.substring(F.col("d__l"), F.lit(1), i - 1))).otherwise(F.array().cast("array<string>"))
    keyed = windows.withColumn("d__k", F.explode_outer(F.array_distinct(F.concat(F.array("d__l"), begins))))
    # labels of targets are few, and most rows have one of a handful: not dealt by label
    matched = keyed.join(F.broadcast(named), (F.col("d__k") == F.col("d__a")) & (F.col("w") <= F.col("d__reach")) & within).drop("d__k", "d__reach")
    # a window's longest label of a target is its label
    rest = [c for c in matched.columns if c not in ("document_id", "page", "start", "w", "d__of", "field_key")]
    longest = F.max_by(F.struct(*rest), F.struct(F.length("label"), "label"))
    one = matched.groupBy("document_id", "page", "start", "w", "d__of", "field_key").agg(longest.alias("d__x")).select(
        "document_id", "page", "start", "w", "d__of", "field_key", *[F.col(f"d__x.{c}").alias(c) for c in rest])
    others = targets.filter("statement != 'summary'").agg(F.collect_set(F.lower(compact(F.col("label")))).alias("d__others"))
    one = one.crossJoin(others)  # one row, of the targets' labels
    packed, own = F.lower(F.translate(compact(F.col("context")), "，", ",")), F.lower(compact(F.col("label")))
    one = one.withColumns({"d__c": packed, "d__own": own}).withColumn("d__s", F.call_function("locate", F.col("d__own"), F.col("d__c")))
    value_at = F.col("d__s") + F.length("d__own")
    nexts = F.transform(F.array_remove("d__others", F.col("d__own")), lambda x: F.nullif(F.call_function("locate", x, F.col("d__c"), value_at), F.lit(0)))
    one = one.withColumn("d__n", F.when(F.col("d__s") > 0, F.array_min(nexts)))
    segment = F.substr(F.translate(compact(F.col("context")), "，", ","), value_at, F.col("d__n") - value_at)
    one = one.withColumn("d__segment", F.when(F.col("d__n").isNotNull(), segment))
    index = lambda test: F.filter(F.transform("d__part", lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    one = one.withColumns({
        "d__in": index(lambda x: _is_label(x["label"], F.col("d__a"))),
        "d__text": index(lambda x: ~x["line"].rlike(ANY_NUMBER)),
        "d__base": F.when(F.col("d__l") == F.col("d__a"), 40).otherwise(20) + F.greatest(F.lit(0), 40 - 10 * F.col("w")),
    })
    first, last = F.array_min("d__in"), F.array_max("d__in")

    def relation(i: Column) -> Column:
        labelled = F.when(F.array_contains("d__in", i), 500).when(i < first, 460 - 10 * (first - i)).when((i > first) & (i < last), 450).otherwise(340 - 10 * (i - last))
        parts = F.when((i > F.array_min("d__text")) & (i < F.array_max("d__text")), 455).otherwise(380)
        return F.when(F.size("d__in") > 0, labelled).otherwise(parts)

    def candidate(x: Column, i: Column) -> Column:
        source = F.coalesce(F.col("d__segment"), x["line"])
        kind = F.col("report_kind") if "report_kind" in lines.columns else F.lit("")
        of_summary = lambda tokens: _summary_amount(tokens, source, kind, F.coalesce("semantics", F.lit("flow")))
        amount = _once(_tokens(source), lambda t: F.when(F.col("summary"), F.coalesce(of_summary(t), _chosen(t))).otherwise(_chosen(t)))
        score = (-(relation(i) + F.col("d__base"))).alias("score")
        return _once(amount, lambda a: F.struct(score, i.alias("i"), a["value"].alias("value"), a["raw"].alias("raw")))

    best = F.array_min(F.filter(F.transform("d__part", candidate), lambda c: c["value"].isNotNull()))
    found = one.withColumn("d__best", F.explode_outer(F.array(best))).filter("d__best is not null")
    keep = [c for c in carried if c not in ("document_id", "page")]
    best = F.struct(F.col("d__best.score").alias("score"), "start", (-F.length("label")).alias("length"), "w", F.col("d__best.value").alias("value"),
        F.col("d__best.raw").alias("raw"), "label", "context", *keep)
    out = found.groupBy("document_id", "page", F.col("d__of").alias("statement_type"), "field_key").agg(F.min(best).alias("b"))
    return out.select("document_id", "page", "statement_type", "field_key", *[F.col(f"b.{c}") for c in ("start", "w", "value", "raw", "label", "context", *keep)], (-F.col("b.score")).alias("score"))


def _scaled(out: DataFrame, keep: list[str]) -> DataFrame:
    """value, unit and tolerance from the columns value, raw and unit of a chosen amount."""
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.col("unit"))
    half = F.lit(0.5) * F.pow(F.lit(10.0), -F.length(F.regexp_extract("raw", r"\.(\d+)", 1)))
    tolerance = F.when(F.col("unit") == "元/股", F.greatest(F.lit(1e-9), half)).otherwise(F.greatest(F.lit(1.0), scale * half))
    return out.select(*keep, (F.col("value") * scale).alias("value"), "unit", tolerance.alias("tolerance"))


def _asked(targets: DataFrame) -> DataFrame:
    more = {"statement": F.lit(""), "summary": F.lit(False), "semantics": F.lit("flow")}
    return targets.withColumns({c: v for c, v in more.items() if c not in targets.columns})


def extracted(texts: DataFrame, targets: DataFrame, width: int = 3, summary_width: int = 6) -> DataFrame:
    """Values of labelled rows: (document_id, field_key, value, unit, tolerance), the best that scored() finds in each text.

    texts: document_id, text, and report_kind (q3 for reports of third quarters) where it is known. The value is scaled by the
    unit of the row, else of the page; the tolerance is half its last digit. No amounts, no row.
    """
    split = F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "line")
    kind = ["report_kind"] if "report_kind" in texts.columns else []
    lines = texts.select("document_id", *kind, F.lit(1).alias("page"), page_unit(F.col("text")).alias("page_unit"), split).withColumn("line", _spaced("line")).filter("line != ''")
    found = scored(lines, _asked(targets), F.lit(True), width, summary_width)
    unit = F.coalesce(row_unit(F.col("context")), F.col("page_unit"), F.lit("元"))
    return _scaled(found.withColumn("unit", unit), ["document_id", "field_key"])


def _spaced(line: str) -> Column:
    return F.trim(F.regexp_replace(F.col(line), r"[\s\u00a0\u3000]+", " "))


def statement_values(lines: DataFrame, targets: DataFrame, width: int = 3, summary_width: int = 6) -> DataFrame:
    """Values of labelled rows within the consolidated statement that a target belongs to, one for each document, statement and field.

    lines: document_id, page, line_no, line, and source and report_kind where they are known; targets: field_key, label,
    statement, summary, semantics. A target of statement `summary` is looked for on every page, one that a summary states
    itself also on the first five pages if they hold key figures. A parent company's statements have no values. Pages of
    consolidated statements score above others, then the earlier page; on a page, scored() decides. Units are the row's, else
    the last that was stated. Values have the sign that their field is shown with.
    """
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    page = Window.partitionBy("document_id", "page")
    unit = F.when(F.contains("line", F.lit("单")), page_unit(F.col("line")))  # few rows are asked in full
    stated = F.last(unit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = in_statements(lines.withColumns({"line": _spaced("line"), "page_unit": stated}).filter("line != ''"))
    key_figures = F.max(F.contains("line", F.lit("据")) & F.contains(compact(F.col("line")), F.lit("主要财务数据"))).over(page) & (F.col("page") <= 5)
    rows = marked.withColumn("key_figures", key_figures)
    summary = F.col("d__of") == "summary"
    within = summary | (F.col("statement") == F.col("d__of")) & (F.col("scope") != "parent") | F.col("key_figures") & F.col("summary")
    found = scored(rows, _asked(targets), within, width, summary_width)
    rank = F.when(F.col("scope") == "consolidated", 75).otherwise(60)
    columns = [c for c in found.columns if c not in ("document_id", "statement_type", "field_key")]
    best = F.min_by(F.struct(*columns), F.struct(-rank, "page", -F.col("score")))
    one = found.groupBy("document_id", "statement_type", "field_key").agg(best.alias("b")).select("document_id", F.col("statement_type"), "field_key", *[F.col(f"b.{c}") for c in columns])
    unit = F.coalesce(row_unit(F.col("context")), F.col("page_unit"), F.lit("元"))
    source = F.col("source") if "source" in lines.columns else F.lit("")
    out = one.withColumns({"unit": unit, "value": signed(F.col("field_key"), F.col("value"), source), "scope": F.coalesce("scope", F.lit("consolidated"))})
    out = out.drop("statement").withColumnRenamed("statement_type", "statement")
    return _scaled(out, ["document_id", "statement", "field_key", "scope", "page", "label", "context", "score"])


# Headings of statements, and of tables that end one.
HEADINGS = {"资产负债表": "balance_sheet", "利润表": "income_statement", "现金流量表": "cash_flow"}
OTHER_TABLES = ["股东权益变动表", "所有者权益变动表", "财务报表附注"]
# Expenses that are shown without a sign.
UNSIGNED = [
    "TREASURY_SHARES", "OPERATE_COST", "TOTAL_OPERATE_COST", "OPERATE_TAX_ADD", "SALE_EXPENSE", "MANAGE_EXPENSE", "RESEARCH_EXPENSE", "FINANCE_EXPENSE",
    "FE_INTEREST_EXPENSE", "INTEREST_EXPENSE", "INCOME_TAX", "NONBUSINESS_EXPENSE", "BUY_SERVICES", "CONSTRUCT_LONG_ASSET", "INVEST_PAY_CASH",
    "REPAY_DEBT_CASH", "ASSIGN_DIVIDEND_PORFIT", "DISTRIBUTE_DIVIDEND_CASH", "SUBSIDIARY_PAY_DIVIDEND",
]
#: Pages for which a heading holds after its own.
HOLDS = 5


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\u00a0\u3000]+", "")


def heading(line: Column) -> Column:
    """(statement, scope) of a line that is a statement's heading, null for others."""
    t = F.regexp_replace(F.translate(compact(line), "()", "（）"), r"^\d+[、.．]", "")
    pattern = r"(合并及公司|合并|母公司|公司)?(资产负债表|利润表|现金流量表)(?:（续）)?$"
    name, owner = F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 1)
    statement = F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), name)
    scope = F.when(owner.isin("母公司", "公司"), "parent").otherwise("consolidated")
    return F.when(statement.isNotNull(), F.struct(statement.alias("statement"), scope.alias("scope")))


def in_statements(lines: DataFrame) -> DataFrame:
    """Lines (document_id, page, line_no, line) with the statement and scope that they stand in, by the last heading before.

    A heading holds to the end of the HOLDS pages after its own, or until a table of another kind begins.
    """
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    ends = F.lit(False)
    for name in OTHER_TABLES:
        ends = ends | F.contains(compact(F.col("line")), F.lit(name))
    mark = F.when(heading(F.col("line")).isNotNull(), F.struct(F.col("page").alias("page"), heading(F.col("line")).alias("h"))).when(ends,
        F.struct(F.col("page").alias("page"), F.lit(None).cast("struct<statement:string,scope:string>").alias("h")))
    mark = F.when(F.contains("line", F.lit("表")), mark)  # as all of them do; few rows are asked in full
    last = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = lines.withColumn("d__m", last)
    holds = F.col("page") <= F.col("d__m.page") + HOLDS
    return out.select(*lines.columns, F.when(holds, F.col("d__m.h.statement")).alias("statement"), F.when(holds, F.col("d__m.h.scope")).alias("scope"))


def document_scope(lines: DataFrame) -> DataFrame:
    """(document_id, scope): FULL_STATEMENTS where a statement's heading occurs, SUMMARY_ONLY where only key figures do, else UNRESOLVED."""
    rank = F.when(heading(F.col("line")).isNotNull(), 2).when(F.contains(compact(F.col("line")), F.lit("主要财务数据")), 1).otherwise(0)
    best = lines.groupBy("document_id").agg(F.max(rank).alias("r"))
    return best.select("document_id", F.when(F.col("r") == 2, "FULL_STATEMENTS").when(F.col("r") == 1, "SUMMARY_ONLY").otherwise("UNRESOLVED").alias("scope"))


def signed(key: Column, value: Column, source: Column) -> Column:
    """A value with the sign that its field is shown with: expenses and payments have none, but for finance expenses of SSE reports."""
    unsigned = key.isin(*UNSIGNED) | F.startswith(key, F.lit("PAY_")) | F.endswith(key, F.lit("_OUTFLOW"))
    as_it_is = (key == "FINANCE_EXPENSE") & (F.upper(F.coalesce(source, F.lit(""))) == "SSE")
    return F.when(unsigned & ~as_it_is, F.abs(value)).otherwise(value)


def summary_amount(line: Column, kind: Column, semantics: Column) -> Column:
    """(raw, value) of the amount of a summary row that a fact is compared with.

    The first one, but in reports of third quarters, of flows: of four amounts (quarter, change, year to date, change) the
    third, and of three with a `不适用` between the first two the second.
    """
    return _once(_tokens(line), lambda tokens: _summary_amount(tokens, line, kind, semantics))


def _summary_amount(tokens: Column, line: Column, kind: Column, semantics: Column) -> Column:
    packed = F.translate(compact(line), "，（）−", ",()-")
    raw = lambda k: F.regexp_replace(F.get(tokens, k)["raw"], r"\s+", "")
    first_at = F.call_function("locate", raw(0), packed)
    between = F.call_function("locate", F.lit("不适用"), packed, first_at + 1)
    second_at = F.call_function("locate", raw(1), packed, first_at + F.length(raw(0)))  # its digits may also end the first
    plain = (kind != "q3") | (semantics == "point_in_time")
    missing = (F.size(tokens) == 3) & (first_at > 0) & (between > first_at) & (second_at > between)
    return F.when(plain, F.get(tokens, 0)).when(F.size(tokens) >= 4, F.get(tokens, 2)).when(missing, F.get(tokens, 1)).otherwise(F.get(tokens, 0))


# Keys of a profile's parts, in order of preference.
PROFILE_KEYS = {
    "name_abbr": ["SECURITY_NAME_ABBR", "SECURITY_NAME", "ORG_NAME_ABBR"], "company_name": ["ORG_NAME", "ORG_NAME_CN", "COMPANY_NAME"],
    "company_name_en": ["ORG_NAME_EN", "ORG_NAME_ENG", "ENGLISH_NAME"], "former": ["FORMERNAME", "FORMER_NAME"],
    "website": ["ORG_WEB", "ORG_WEB_SITE", "OFFICIAL_WEBSITE", "WEB_SITE", "WEBSITE"], "industry": ["CSRC_INDUSTRY_NAME"], "board_1": ["BOARD_NAME_1LEVEL"],
    "board_2": ["BOARD_NAME_2LEVEL"], "board_3": ["BOARD_NAME_3LEVEL"], "brand_1": ["EXPAND_NAME_ABBR"], "brand_2": ["EXPAND_NAME_ABBRN"],
}


def profiles(facts: DataFrame) -> DataFrame:
    """A row for each security from its facts (security_code, ordinal of the record, field_key, value_text): the first value by
    order of keys, then of records, that isn't empty."""
    wanted = [F.struct(F.lit(part).alias("part"), F.lit(k).alias("k"), F.lit(r).alias("r")) for part, keys in PROFILE_KEYS.items() for r, k in enumerate(keys)]
    rows = facts.filter(~F.coalesce("value_text", F.lit("")).isin("", "[]", "{}"))
    named = rows.withColumn("d__p", F.explode(F.filter(F.array(*wanted), lambda x: x["k"] == F.col("field_key"))))
    first = lambda part: F.min_by(F.when(F.col("d__p.part") == part, F.col("value_text")),
        F.when(F.col("d__p.part") == part, F.struct("d__p.r", "ordinal", "value_text"))).alias(part)
    g = named.groupBy("security_code").agg(*[first(p) for p in PROFILE_KEYS])
    site = F.when(~F.col("website").rlike("^https?://"), F.concat(F.lit("https://"), "website")).otherwise(F.col("website"))
    names = F.filter(F.transform(F.split(F.coalesce("former", F.lit("")), "[,，;；]"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda *parts: F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(p), F.lit("")) for p in parts])))
    return g.select(
        "security_code", "name_abbr", F.coalesce("company_name", "name_abbr").alias("company_name"), "company_name_en", names.alias("former_names"),
            site.alias("website"),
        words("industry", "board_1", "board_2", "board_3").alias("industry_keywords"), words("name_abbr", "brand_1", "brand_2").alias("brand_keywords"),
    )
