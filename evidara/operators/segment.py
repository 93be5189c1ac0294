"""From page layouts to logical units: titles, stages, blocks, sections, dataset checks.

A page is (page_num, full_text, lines array<struct<text,size>>).  Every step is an expression
over one page's row; nothing is shuffled until the dataset reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara import schemas
from evidara.functions.text import clean_text, let, md5_12, scan, strip

#: Section headers that never are titles (matched as substrings).
KNOWN_HEADERS = (
    "definition", "why is this a red flag?", "unit of analysis", "type of red flag", "stage", "source", "required data fields", "methodology", "example", "data fields needed", "ocds fields", "why is this a red flag", "collusion risks", "bid-rigging", "fraud", "low competition", "low transparency",
)
#: Block headers and the type of block that they open.
BLOCK_HEADERS = {
    "definition": "core", "why is this a red flag": "core", "unit of analysis": "core", "type of red flag": "core", "stage": "core", "source": "core", "example": "example", "methodology": "formula", "required data fields": "formula", "data fields needed": "formula", "ocds fields": "formula",
}
#: Stages and the keywords that tell them, the first stage with a hit wins.
STAGE_KEYWORDS = (
    ("contract", (
        "contract", "delivery", "subcontract", "amendment", "modification", "signature", "transaction", "price increase", "reduce line", "increase line", "work completed", "specifications", "losing bidders hired", "contractor subcontracts", "prevalence of subcontracts", "decision period", "contract is not published", "contract has modifications", "contract amount", "value and final contract amount", "contract signature date", "supplier followed by", "heterogeneous supplier", "supplier is not traceable", "small initial purchase",
    )),
    ("award", (
        "award", "winning", "disqualified", "identical bid", "late bid won", "bid rotation", "heavily discounted", "award value", "direct award", "below threshold", "change orders", "award criteria", "all except winning", "lowest bid disqualified", "poorly supported disqualifications", "excessive disqualified", "high share of buyer", "high market share", "high market concentration", "losing bidder", "buyer's contracts", "excessive unsuccessful bids", "missing bidders", "prevalence of consortia", "co-bidding pairs", "recurrent winner", "multiple direct awards",
    )),
    ("tender", (
        "tender", "bid", "bidding", "submission", "prequalification", "participation", "complaint", "consortia", "missing bidders", "unsuccessful bids", "time between", "advertising", "opening", "evaluation", "single bid", "low number of bidders", "fixed-multiple", "disparity", "close to winning", "short time between", "long time between", "the submission period", "unreasonable technical specifications", "unreasonable participation fees", "cost of the bidding documents", "non competitive procedure", "unreasonably low or high line item", "line item",
    )),
    ("planning", ("planning", "documents", "advertise", "request for bids", "non-competitive methods", "procurement plan", "procurement thresholds", "manipulation of procurement")),
)
#: Family of each stage.
STAGE_FAMILY = {"planning": "planeacion", "tender": "competencia/licitacion", "award": "adjudicacion", "contract": "ejecucion/contrato"}
#: Markers of an indicator page.
INDICATOR_MARKS = ("Definition", "Why is this a red flag")
CODE = r"R\d{3}"
#: Font sizes that stand for HTML tags where pages come as HTML instead of laid-out print.
TAG_SIZES = {"title": 20.0, "h1": 24.0, "h2": 18.0, "h3": 16.0, "b": 14.0, "p": 12.0, "li": 10.0}
#: HTML elements that don't end a line.
INLINE_TAGS = tuple("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Character references that are decoded, the ampersand's last.
REFERENCES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&",
}
#: What a page doesn't show, and its tags and text runs; read alike by Java and RE2.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
TAG_OR_TEXT = r"</?[a-zA-Z][^<>]*>|<[!?][^<>]*>|<|[^<]+"
LAYOUT_LABEL = r"(?i)^\s*(header|footer|page\s*\d*|figure\s*\d*|table\s*\d*|image|caption|title|section|content|body|left|right|top|bottom)\s*:?\s*$"


def _tags(html: Column) -> Column:
    """array<struct<name,closing,text>>: tags and text runs of a page in order; a run has no name."""
    seen = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    name = lambda x: F.lower(F.regexp_extract(x, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    none = lambda x: x.rlike("^<[!?]")
    made = F.transform(F.regexp_extract_all(seen, F.lit(TAG_OR_TEXT), F.lit(0)), lambda x: F.struct(F.when(none(x), F.lit("!")).otherwise(name(x)).alias("name"), x.startswith("</").alias("closing"), x.alias("text")))
    end = F.array(F.struct(F.lit("html").alias("name"), F.lit(True).alias("closing"), F.lit("").alias("text")))
    return F.concat(made, end)


def html_lines(html: Column, sizes=None, body: float = 12.0, inline=INLINE_TAGS) -> Column:
    """Lines of an HTML page as array<struct<text,size>>, all its visible text in page order.

    A scan over tags and text runs keeps the sized tags that are open.  A line ends at every tag
    that isn't inline; its text is that of its runs, its size the largest size in force in them.
    In force is the innermost sized tag, ``body`` without any; an inline one never makes text
    smaller.  A tag that opens while another of its name is open closes that one and all inside,
    so the scan's state stays as small as ``sizes``.  Null and empty pages have no lines.
    """
    sizes = sizes or TAG_SIZES
    table = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    is_inline = lambda n: n.isin("!", *inline)
    zero = F.struct(F.array().cast("array<struct<name:string,size:double>>").alias("open"), F.lit("").alias("text"), F.lit(0.0).alias("size"))
    in_force = lambda open_: F.coalesce(F.get(open_, F.size(open_) - 1)["size"], F.lit(float(body)))

    def text_run(s: Column, x: Column) -> Column:
        size = F.when(x["text"].rlike(r"\S"), F.greatest(s["size"], in_force(s["open"]))).otherwise(s["size"])
        return F.struct(s["open"].alias("open"), F.concat(s["text"], x["text"]).alias("text"), size.alias("size"))

    def tag(s: Column, x: Column) -> Column:
        at = F.array_position(F.transform(s["open"], lambda o: o["name"]), x["name"]).cast("int")
        kept = lambda n: F.when(n > 0, F.slice(s["open"], F.lit(1), n - 1)).otherwise(s["open"])
        size = F.try_element_at(table, x["name"])
        pushed = lambda o: F.concat(o, F.array(F.struct(x["name"].alias("name"), F.when(is_inline(x["name"]), F.greatest(size, in_force(o))).otherwise(size).alias("size"))))
        open_ = F.when(size.isNull(), s["open"]).otherwise(let(let(at, kept), lambda o: F.when(x["closing"], o).otherwise(pushed(o))))
        stays = is_inline(x["name"])
        return F.struct(open_.alias("open"), F.when(stays, s["text"]).otherwise("").alias("text"), F.when(stays, s["size"]).otherwise(0.0).alias("size"))

    def emitted(s: Column, x: Column) -> Column:
        line = F.struct(s["text"].alias("text"), s["size"].alias("size"))
        return F.when((x["name"] != "") & ~is_inline(x["name"]) & (s["size"] > 0), F.array(line)).otherwise(F.array().cast("array<struct<text:string,size:double>>"))

    lines = scan(_tags(html), zero, lambda s, x: F.when(x["name"] == "", text_run(s, x)).otherwise(tag(s, x)), emitted, "struct<text:string,size:double>")
    tidy = lambda t: strip(F.regexp_replace(_unescaped(t), r"\s+", " "))
    return F.filter(F.transform(lines, lambda x: F.struct(tidy(x["text"]).alias("text"), x["size"].alias("size"))), lambda x: x["text"] != "")


def _unescaped(t: Column) -> Column:
    for k, v in REFERENCES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    return t


def pages_from_html(pages: DataFrame) -> DataFrame:
    """(page_num, full_text, lines) from (page_id, html)."""
    lines = pages.select(F.col("page_id").cast("int").alias("page_num"), html_lines(F.col("html")).alias("lines"))
    return lines.select("page_num", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("full_text"), "lines")


def title(lines: Column, headers=KNOWN_HEADERS, least: float = 16.0, band: float = 2.0) -> Column:
    """Title of a page: its largest lines that aren't headers, largest first; null if too short."""

    def fits(x: Column) -> Column:
        low, ok = F.lower(x["text"]), (x["size"] >= least) & (F.length(x["text"]) > 3) & ~x["text"].rlike(r"(?U)^\d+$")
        for h in headers:
            ok = ok & ~low.contains(h)
        return ok

    ranked = F.sort_array(F.transform(F.filter(lines, fits), lambda x, i: F.struct((-x["size"]).alias("s"), i.alias("i"), x["text"].alias("t"))))

    def joined(r: Column) -> Column:
        best = F.filter(r, lambda x: x["s"] <= F.element_at(r, 1)["s"] + band)
        text = F.regexp_replace(F.array_join(F.transform(best, lambda x: x["t"]), " "), r"(?U)\s+", " ")
        return strip(F.regexp_replace(F.regexp_replace(text, r"\s*R\d{3}\s*$", ""), r"^\s*R\d{3}\s*", ""))

    return let(ranked, lambda r: F.when(F.size(r) > 0, let(joined(r), lambda t: F.when(F.length(t) > 3, t))))


def code(text: Column, pattern: str = CODE) -> Column:
    """First code in a text, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def stage(title_: Column, keywords=STAGE_KEYWORDS) -> Column:
    """First stage, in table order, one of whose keywords the lower-cased title contains."""
    low = F.lower(F.coalesce(title_, F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(keywords):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def family(stage_: Column, families=None) -> Column:
    out = F.lit("unknown")
    for s, f in (families or STAGE_FAMILY).items():
        out = F.when(stage_ == s, f).otherwise(out)
    return out


def is_indicator(text: Column, marks=INDICATOR_MARKS, pattern: str = CODE) -> Column:
    ok = text.rlike(pattern)
    for m in marks:
        ok = ok & text.contains(m)
    return ok


def blocks(text: Column, headers=None, least: int = 30) -> Column:
    """array<struct<kind,text>>: runs of a cleaned text by the type of the header lines above.

    Text before the first header is left out, as are runs of ``least`` characters or fewer; a
    text without any run is one core block.
    """
    headers = headers or BLOCK_HEADERS

    def kind(line: Column) -> Column:
        name = F.lower(F.regexp_replace(strip(line), r"\s*[?:]?$", ""))
        return F.try_element_at(F.create_map(*[F.lit(v) for kv in headers.items() for v in kv]), name)

    def runs(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n", -1), lambda x: F.struct(kind(x).alias("kind"), x.alias("line")))
        zero = F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("text"), F.array().cast("array<struct<kind:string,text:string>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            opens = x["kind"].isNotNull() & ~x["kind"].eqNullSafe(s["kind"])
            closed = F.when(s["kind"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["kind"].alias("kind"), s["text"].alias("text"))))).otherwise(s["out"])
            more = F.when(s["kind"].isNotNull(), F.concat(s["text"], F.lit("\n"), x["line"])).otherwise(F.lit(""))
            return F.struct(F.when(opens, x["kind"]).otherwise(s["kind"]).alias("kind"), F.when(opens, x["line"]).otherwise(more).alias("text"), F.when(opens, closed).otherwise(s["out"]).alias("out"))

        end = lambda s: F.when(s["kind"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["kind"].alias("kind"), s["text"].alias("text"))))).otherwise(s["out"])
        found = F.transform(F.aggregate(lines, zero, step, end), lambda x: F.struct(x["kind"].alias("kind"), strip(x["text"]).alias("text")))
        kept = F.filter(found, lambda x: F.length(x["text"]) > least)
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.struct(F.lit("core").alias("kind"), t.alias("text")))))

    return let(clean_text(text), runs)


def sections(text: Column, lines: Column, least_size: float = 14.0, least: int = 50) -> Column:
    """array<struct<name,text>>: sections of a methodology page by its large lines.

    Headers are looked up anywhere in the cleaned text; a hit within ten characters of a kept
    one is dropped.  Pages under 100 characters have none; fewer than two headers, or no section
    over ``least`` characters, give one section of the whole page.
    """
    pair = "array<struct<name:string,text:string>>"

    def hits(t: Column, heads: Column) -> Column:
        def of(h: Column) -> Column:
            quoted = F.concat(F.lit("\\Q"), F.replace(h, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,name:string>>").alias("out"))
            parts = F.split(t, quoted, -1)
            walked = F.aggregate(
                F.slice(parts, 1, F.size(parts) - 1),
                zero,
                lambda s, p: F.struct((s["at"] + F.length(p) + F.length(h)).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + F.length(p)).alias("pos"), h.alias("name")))).alias("out")),
                lambda s: s["out"],
            )
            return walked

        return F.sort_array(F.array_distinct(F.flatten(F.transform(heads, of))))

    def apart(found: Column) -> Column:
        zero = F.array().cast("array<struct<pos:int,name:string>>")
        return F.aggregate(found, zero, lambda s, x: F.when((F.size(s) > 0) & (x["pos"] - F.get(s, F.size(s) - 1)["pos"] < 10), s).otherwise(F.concat(s, F.array(x))))

    def cut(t: Column, marks: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = x["pos"] + F.length(x["name"])
            end = F.coalesce(F.get(marks, i + 1)["pos"], F.length(t))
            return F.struct(x["name"].alias("name"), strip(F.substring(t, start + 1, F.greatest(end - start, F.lit(0)))).alias("text"))

        return F.filter(F.transform(marks, one), lambda x: F.length(x["text"]) > least)

    heads = F.filter(F.transform(lines, lambda x: F.struct(strip(x["text"]).alias("t"), x["size"].alias("size"))), lambda x: (x["size"] >= least_size) & (F.length(x["t"]) > 3) & ~x["t"].rlike(r"(?U)^\d+$"))

    def page(t: Column) -> Column:
        def with_heads(h: Column) -> Column:
            whole = F.array(F.struct(F.coalesce(F.get(h, F.lit(0)), F.lit("General")).alias("name"), t.alias("text")))
            made = let(apart(hits(t, h)), lambda m: cut(t, m))
            return F.when(F.length(t) < 100, F.array().cast(pair)).when(F.size(h) < 2, whole).otherwise(let(made, lambda s: F.when(F.size(s) > 0, s).otherwise(whole)))

        return let(F.transform(heads, lambda x: x["t"]), with_heads)

    return let(clean_text(F.coalesce(text, F.lit(""))), page)


def indicator_units(pages: DataFrame, source_file: str = "", headers=None) -> DataFrame:
    """Units of indicator pages; a page's first unit is the parent of its others."""
    ready = pages.select("page_num", title(F.col("lines")).alias("name"), code(F.col("full_text")).alias("code"), blocks(F.col("full_text"), headers).alias("b"))
    ready = ready.withColumn("stage", stage(F.col("name")))
    item = lambda b: F.struct(
        F.concat(F.lit("ocp_"), F.coalesce("code", F.lit("unk")), F.lit("_"), b["kind"], F.lit("_"), md5_12(b["text"])).alias("doc_id"), b["kind"].alias("kind"), b["text"].alias("text"), md5_12(b["text"]).alias("hash")
    )
    again = F.filter(F.transform("b", lambda b: F.struct(b["kind"].alias("kind"), clean_text(b["text"]).alias("text"))), lambda b: F.length(b["text"]) >= 30)
    # outer, as an inner one gets a filter on the array's size that repeats the whole work on the page
    units = ready.withColumn("u", F.transform(again, item)).select("*", F.posexplode_outer("u").alias("n", "x")).where("n is not null")
    out = units.select(
        "x.doc_id", F.when(F.col("n") > 0, F.get("u", F.lit(0))["doc_id"]).alias("parent_doc_id"), F.lit(source_file).alias("source_file"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), F.lit("indicator").alias("section"),
        F.col("x.kind").alias("block_type"), family(F.col("stage")).alias("family"), "stage", F.col("code").alias("indicator_code"), F.col("name").alias("indicator_name"), "x.hash", "x.text",
    )
    return out.select(*schemas.UNITS.names)


def methodology_units(pages: DataFrame, source_file: str = "") -> DataFrame:
    """Units of the other pages, one a section."""
    cut = pages.select("page_num", F.explode(sections(F.col("full_text"), F.col("lines"))).alias("s"))
    out = cut.select(
        F.concat(F.lit("ocp_meta_p"), F.lpad(F.col("page_num").cast("string"), F.greatest(F.lit(3), F.length(F.col("page_num").cast("string"))), F.lit("0")), F.lit("_"), md5_12(F.col("s.text"))).alias("doc_id"), F.lit(None).cast("string").alias("parent_doc_id"), F.lit(source_file).alias("source_file"),
        F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), F.lit("metodologia").alias("section"), F.lit("section").alias("block_type"), F.lit("metodologia").alias("family"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("indicator_code"), F.col("s.name").alias("indicator_name"), md5_12(F.col("s.text")).alias("hash"), F.col("s.text").alias("text"),
    )
    return out.select(*schemas.UNITS.names)


def load_pages(pages: DataFrame, source_file: str = "", least: int = 100) -> DataFrame:
    """Units of a whole document: indicator pages and, of the rest, pages over ``least`` characters."""
    flagged = pages.withColumn("_i", is_indicator(F.col("full_text")))
    rest = flagged.where(~F.col("_i") & (F.length(strip(F.col("full_text"))) > least))
    return indicator_units(flagged.where("_i"), source_file).unionByName(methodology_units(rest, source_file))


def quality_report(units: DataFrame, least_units: int = 100, least_names: float = 95.0) -> DataFrame:
    """One row of counts, name coverage, missing families and whether all criteria hold."""
    u = F.col
    of = lambda c: F.sum(c.cast("long"))
    ind = u("section") == "indicator"
    sums = units.agg(
        F.count(F.lit(1)).alias("total_units"), F.countDistinct(F.when(ind, u("page_start"))).alias("indicator_pages"), F.coalesce(of(ind), F.lit(0)).alias("indicator_units"), F.coalesce(of(u("section") == "metodologia"), F.lit(0)).alias("methodology_units"),
        F.coalesce(of(ind & (F.coalesce("indicator_name", F.lit("")) != "")), F.lit(0)).alias("named"), F.coalesce(of(u("family") == "unknown"), F.lit(0)).alias("unknown_family_count"), F.collect_set("family").alias("seen"),
    )
    share = F.when(u("indicator_units") > 0, u("named") / u("indicator_units") * 100).otherwise(0.0)
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in schemas.INDICATOR_FAMILIES]), u("seen")))
    ok = (u("total_units") >= least_units) & (share >= least_names) & (u("unknown_family_count") == 0) & (F.size(missing) == 0)
    return sums.select("total_units", "indicator_pages", "indicator_units", "methodology_units", F.bround(share, 1).alias("indicator_name_coverage_pct"), "unknown_family_count", F.array_join(missing, ",").alias("missing_families"), ok.alias("criteria_passed"))


def distribution(units: DataFrame, column: str, missing: str = "null") -> DataFrame:
    return units.groupBy(F.coalesce(column, F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def violations(units: DataFrame) -> DataFrame:
    """(doc_id, problem): rows that break the dataset contract."""
    first = F.get(F.split(F.coalesce("text", F.lit("")), "\n", 2), F.lit(0))
    full = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), strip), lambda x: x != "")
    tests = {
        "section": ~F.coalesce(F.col("section").isin(*schemas.SECTIONS), F.lit(False)),
        "block_type": ~F.coalesce(F.col("block_type").isin(*schemas.BLOCK_TYPES), F.lit(False)),
        "family": ~F.coalesce(F.col("family").isin(*schemas.FAMILIES), F.lit(False)),
        "empty_text": F.size(full) == 0,
        "page_number_first": first.rlike(r"^\s*\d{1,3}\s*$"),
        "layout_labels_only": (F.size(full) > 0) & F.forall(full, lambda x: x.rlike(LAYOUT_LABEL)),
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]), lambda x: x.isNotNull())
    return units.select("doc_id", F.explode(found).alias("problem"))


def orphan_parents(units: DataFrame) -> DataFrame:
    """(doc_id, parent_doc_id) of units whose parent isn't a core unit."""
    core = units.where("block_type = 'core'").select(F.col("doc_id").alias("parent_doc_id"))
    return units.where("parent_doc_id is not null").join(core, "parent_doc_id", "left_anti").select("doc_id", "parent_doc_id")
