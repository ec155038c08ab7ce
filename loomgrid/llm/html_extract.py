"""Main text of web pages by line-block distribution.

Markup is stripped to lines: comments and elements that hold no text (scripts, styles, the head) go whole, tags of
paragraphs and the like end a line, tags of sections leave WIDTH empty lines, other tags vanish, and character
references are resolved. The block of a line is the summed length of it and the next WIDTH - 1 lines. Going down the page, a block of more than
`surge` characters is a surge point; the next empty block is its dive point; the lines between are kept, and the
search goes on below.

Defined results: null html gives null text; html without a surge point, empty or blank html give empty text and no lines; a tag that isn't closed by >
is text; an element that isn't closed is not dropped; white space at the ends of a line doesn't count; repeated rows and null ids are kept; pages of any length are read whole, in time in proportion to their length, well-formed or not; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm.common import arrow_map, pick

WIDTH, SURGE = 3, 140
SPACE = " \t\r\f"
EMPTY = ("script", "style", "noscript", "template", "svg", "iframe", "head")
REST = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>"""
SECTION = "html|body|header|footer|nav|main|article|section|aside|div|form|table|thead|tbody|tfoot|ul|ol|dl|figure|fieldset|hr"
LINE = "p|h1|h2|h3|h4|h5|h6|li|br|tr|td|th|dt|dd|blockquote|pre|title|caption|figcaption|option|address|details|summary|center"
#: In the order in which they are applied: pattern, what it becomes. SQL applies them as they stand (RE2 takes time in
#: proportion to the text); Python's expressions would try each unclosed tag to the end of the page.
STEPS = [(r"(?is)<!--.*?-->", "")]
STEPS += [(rf"(?is)<{x}\b[^>]*>.*?</{x}[ \t\r\n\f]*>", "") for x in EMPTY]
STEPS += [(rf"(?i)</?(?:{SECTION})(?:[ \t\r\n\f/]{REST}|>)", "\n" * (WIDTH + 1)), (rf"(?i)</?(?:{LINE})(?:[ \t\r\n\f/]{REST}|>)", "\n"), (rf"<[!/?a-zA-Z]{REST}", "")]


#: The same steps for one pass each from left to right: where an element or tag begins, and where it ends.
COMMENT = (re.compile("<!--"), re.compile("-->"))
ELEMENTS = [(re.compile(rf"(?i)<{x}\b"), re.compile(rf"(?i)</{x}[ \t\r\n\f]*>")) for x in EMPTY]
TAGS = [(re.compile(rf"(?i)</?(?:{x})(?=[ \t\r\n\f/>])"), n) for x, n in ((SECTION, 2), (LINE, 1))] + [(re.compile("<[!/?a-zA-Z]"), 0)]
SPECIAL = re.compile("[>\"']")
DECIMAL = re.compile(r"&#([0-9]{8,});?")


def without_elements(html: str, opener: re.Pattern, closer: re.Pattern, tag: bool) -> str:
    """The text without what lies from each opener to the next closer. Where one has no closer, none behind it has."""
    out, at = [], 0
    while m := opener.search(html, at):
        inside = html.find(">", m.end()) + 1 if tag else m.end()
        end = closer.search(html, inside) if inside else None
        if not end:
            break
        out.append(html[at : m.start()])
        at = end.end()
    return "".join(out) + html[at:] if out else html


class Ends:
    """Behind which > a tag ends: the first that isn't quoted. Asked from left to right.

    Quotes from which no end is reached are remembered, so that a page takes time in proportion to its length.
    """

    def __init__(self, html: str):
        self.html, self.nowhere, self.at = html, set(), -1
        self.last = {q: html.rfind(q) for q in "\"'"}

    def special(self, i: int) -> int:
        m = SPECIAL.search(self.html, i)
        return m.start() if m else len(self.html)

    def __call__(self, i: int) -> int | None:
        if self.at < i:
            self.at = self.special(i)
        s, path = self.at, []
        while s < len(self.html) and s not in self.nowhere:
            c = self.html[s]
            if c == ">":
                return s + 1
            path.append(s)
            if self.last[c] <= s:
                break
            s = self.special(self.html.find(c, s + 1) + 1)
        self.nowhere.update(path)
        return None


def without_tags(html: str, head: re.Pattern, becomes: str) -> str:
    out, at, ends = [], 0, None
    for m in head.finditer(html):
        if m.start() < at:
            continue
        i = m.end()
        if html.startswith(">", i):
            end = i + 1
        else:
            ends = ends or Ends(html)
            end = ends(i if head is TAGS[-1][0] else i + 1)
        if end:
            out += [html[at : m.start()], becomes]
            at = end
    return "".join(out) + html[at:] if out else html


def resolved(text: str) -> str:
    """Character references resolved; numbers of more digits than a character has are U+FFFD, as any that is none."""
    if "&" not in text:
        return text
    return entities.unescape(DECIMAL.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or 0};", text))


def lines(html: str, width: int = WIDTH) -> list[str]:
    html = without_elements(html, *COMMENT, False)
    for opener, closer in ELEMENTS:
        html = without_elements(html, opener, closer, True)
    for head, n in TAGS:
        html = without_tags(html, head, "\n" * (width + 1 if n > 1 else n))
    return [x.strip(SPACE) for x in resolved(html).split("\n")]


def kept(rows: list[str], width: int = WIDTH, surge: int = SURGE) -> list[str]:
    """The lines between surge and dive points that aren't empty."""
    out, inside = [], False
    sizes = list(map(len, rows)) + [0] * width
    block = sum(sizes[:width])
    for i, row in enumerate(rows):
        if not block:
            inside = False
        elif block > surge:
            inside = True
        if inside and row:
            out.append(row)
        block += sizes[i + width] - sizes[i]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", width: int = WIDTH, surge: int = SURGE) -> DataFrame:
    """page_id, text, n_lines, n_chars of every page: a map without a shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        got = [None if x is None else kept(lines(x, width), width, surge) for x in batch.column("text").to_pylist()]
        texts = [None if x is None else "\n".join(x) for x in got]
        return {"page_id": batch.column("page_id"), "text": texts, "n_lines": [x and len(x) or 0 for x in got], "n_chars": [x and len(x) or 0 for x in texts]}

    return arrow_map(pick(pages, page_id=pages[id_col].cast("long"), text=pages[html_col].cast("string")), run, "page_id long, text string, n_lines long, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql(width: int = WIDTH, surge: int = SURGE) -> str:
    """The same in DuckDB's SQL, for pages whose character references are the named ones below."""
    t = "html"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    for p, r in STEPS:
        t = f"regexp_replace({t}, {q(p)}, {'repeat(chr(10), ' + str(width + 1 if len(r) > 1 else len(r)) + ')'}, 'g')"
    for name, c in {"nbsp": "chr(160)", "copy": "chr(169)", "middot": "chr(183)", "quot": "chr(34)", "lt": "'<'", "gt": "'>'", "amp": "'&'"}.items():
        t = f"replace({t}, '&{name};', {c})"
    t = f"replace({t}, '&#39;', chr(39))"
    return f"""
with a as (select page_id, html, row_number() over () as r_, string_split({t}, chr(10)) as l_ from pages),
b as (select r_, generate_subscripts(l_, 1) as i, trim(unnest(l_), ' ' || chr(9) || chr(13) || chr(12)) as s from a),
c as (select *, sum(length(s)) over (partition by r_ order by i rows between current row and {width - 1} following) as k from b),
d as (select *, sum(case when k = 0 then 1 else 0 end) over (partition by r_ order by i) as g from c),
e as (select *, min(case when k > {surge} then i end) over (partition by r_, g) as f from d),
h as (select r_, string_agg(s, chr(10) order by i) as text, count(*) as n_lines from e where k > 0 and i >= f and length(s) > 0 group by 1)
select page_id, case when html is not null then coalesce(text, '') end as text, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(length(text), 0) as bigint) as n_chars from a left join h using (r_)
"""
