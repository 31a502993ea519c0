"""HTML extraction by equivalence classes of tokens on pages of the same host.

Pass 1 turns every page into tokens: a tag with its path of block elements (each with its first class name), or a text
run with its path.  Each page sends (host, token, count on the page); summing both halves of a hash of (page, count) gives
every token a digest of its occurrence vector, so tokens with equal vectors over all pages of the host fall into one class
without gathering a host anywhere.  The root class holds the tokens found equally often on every page, and a class with another
vector nests in the element whose tag is one of its members.

Deduction, for hosts with at least MIN_PAGES pages: the elements of the root class found once on each page delimit the
slots.  The main slot is the deepest of them (article and main first) with at least half of the host's open text,
which is neither template nor in a menu or the like.  Text runs of valid classes are template too and go, wherever they
stand; inside article or main, where an error costs article text, they need MIN_MAIN pages, the root class, and together
at most MAX_SHARE of the open text (more than that is copies of one page).  Elsewhere they may be MAX_AROUND of it (MAX_FEW
if they have up to FEW code points a page); a host with more has near copies of one page and keeps them.  A nested class
whose pages share more text outside its own elements than inside is a group of near copies too.  Pages of a host with equal
open text count once, so copies are no evidence.

Pass 2 reads each page against its host's template and keeps the main slot without nested slots that are no article: a
menu, header, footer, sidebar, notice, advert, form, script, style or comment section (by element, role, or a word of class
or id), and without what lies outside article or main where the page has one.  Hosts with too few pages, or whose pages
share no such element, have no slot and keep their text by region alone.

Defined results: null or empty html gives an empty text; null url is a host of its own; unclosed or stray tags close with
their block, a tag without its > runs to the end of the page, < without a name is text; page ids may have any type; repeated pages count once and each get a row; an empty table gives an empty result.  Character references are
decoded, white space `[\\x20\\x09-\\x0D]` in a block becomes one space, blocks join by one newline.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import keep, sized, table
from .url_filters import host_of

MIN_PAGES = 5
MIN_MAIN, MAX_SHARE = 10, 0.2
#: Template text outside article and main: up to this share of the host's open text, or up to the larger one while it has few code points a page.
MAX_AROUND, MAX_FEW, FEW = 0.5, 0.8, 100
#: Elements that can delimit the main slot; how article and main look in a path.
BOXES = ("article", "main", "body", "div", "section", "td")
IN_MAIN = r"/(article|main)(\.[^/]*)?(/|$)"
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_QUOTED = re.compile(r"[\"'>]")
_ATTR = re.compile(r"\b(class|id|role)\s{0,9}=\s{0,9}(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template svg math iframe textarea title object select".split())
_AWAY = frozenset("head nav aside form script style noscript template svg math iframe textarea title object select button menu dialog footer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_HINTS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer notice notices cookie cookies consent alert popup modal newsletter subscribe signup "
                   "comment comments disqus replies respond share sharing social related widget toolbar pagination pager".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_P_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Scan:
    """Tags of a page from left to right, in linear time: each search starts where an earlier one ended, and what was not found
    once is not looked for again.  A tag that is never closed runs to the end of the page; < without a name, ! or ? is text."""

    def __init__(self, page: str):
        self.page, self.size, self.none = page, len(page), set()

    def find(self, what: str, at: int) -> int:
        """Place of `what` from `at` on, else the page's end."""
        if what in self.none:
            return self.size
        place = self.page.find(what, at)
        if place < 0:
            self.none.add(what)
            return self.size
        return place

    def close(self, at: int) -> int:
        """Place of the > that ends a tag, outside quotes; a quote that is never closed is a plain character."""
        while m := _QUOTED.search(self.page, at):
            if m[0] == ">":
                return m.start()
            end = self.find(m[0], m.end())
            at = end + 1 if end < self.size else m.end()
        return self.size

    def next(self, at: int) -> tuple[int, int, str, str, bool, bool] | None:
        """(start, end, name, attributes, closing, self-closing) of the next tag; comments and the like have an empty name."""
        page, look = self.page, at
        while (start := self.find("<", look)) < self.size:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, min(end + 3, self.size), "", "", False, False
            if page.startswith("<![CDATA[", start):
                end = self.find("]]>", start + 9)
                return start, min(end + 3, self.size), "", "", False, False
            if page.startswith(("<!", "<?"), start):
                return start, min(self.find(">", start) + 1, self.size), "", "", False, False
            closing = page.startswith("</", start)
            if m := _NAME.match(page, start + 1 + closing):
                end = self.close(m.end())
                attrs = page[m.end():end]
                return start, min(end + 1, self.size), m[0].lower(), attrs, closing, attrs.endswith("/")
            look = start + 1
        return None


class _Frame:
    __slots__ = ("away", "main", "name", "path")

    def __init__(self, name: str, path: str, away: bool, main: bool):
        self.name, self.path, self.away, self.main = name, path, away, main


def _segment(name: str, attrs: str) -> str:
    """Element name and first class name, without digits, which often are ids."""
    for key, *values in _ATTR.findall(attrs):
        if key.lower() == "class" and (classes := next((v for v in values if v), "").split()):
            return f"{name}.{re.sub('[0-9/]+', '', classes[0])}"
    return name


def _hinted(attrs: str) -> bool:
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        if key.lower() == "role":
            if value in _ROLES:
                return True
        elif any(w in _HINTS for name in value.split() for w in (name, *re.split(r"[-_]+", name))):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[str, _Frame, str]], bool]:
    """[(kind, frame, value)] with kind `tag`, `text` or `block` (a block boundary), and whether there is a main region."""
    stack = [_Frame("", "", False, False)]
    out: list[tuple[str, _Frame, str]] = []
    main, at, size, scan = False, 0, len(page), _Scan(page)
    while at < size:
        found = scan.next(at)
        if found is None:
            break
        start, end, name, attrs, closing, alone = found
        if start > at:
            out.append(("text", stack[-1], page[at:start]))
        at = end
        if not name:
            continue
        if name in _RAW and not closing and not alone:
            while (close := scan.find("</", at)) < size and page[close + 2:close + 2 + len(name)].lower() != name:
                at = close + 2
            out.append(("tag", stack[-1], name))
            at = min(scan.find(">", close) + 1, size) if close < size else size
            if name not in _INLINE:
                out.append(("block", stack[-1], name))
            continue
        if name in _INLINE:
            if name == "br":
                out.append(("text", stack[-1], " "))
            continue
        out.append(("block", stack[-1], name))
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                out.append(("tag", stack[depth], "/"))
                del stack[depth:]
            continue
        if name in _CLOSES or name in _P_ENDERS:
            shut = _CLOSES.get(name, ()) or ("p",)
            if stack[-1].name in shut or (stack[-1].name == "p" and name in _P_ENDERS):
                stack.pop()
        top = stack[-1]
        here = name in ("article", "main")
        away = top.away or name in _AWAY or (name == "header" and not top.main) or _hinted(attrs)
        if here and not away:
            main = True
        segment = _segment(name, attrs)
        frame = _Frame(name, f"{top.path}/{segment}", away, top.main or here)
        out.append(("tag", frame, segment))
        if name not in _VOID and not alone:
            stack.append(frame)
    if at < size:
        out.append(("text", stack[-1], page[at:]))
    return out, main


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip(" ")


def page_tokens(page: str) -> dict[str, tuple[int, int]]:
    """Template token -> (count on the page, code points of text below it outside menus and the like).  The empty token is the page."""
    counts, own, chars = Counter([""]), Counter(), Counter()
    for kind, frame, value in parse(page)[0]:
        if kind == "tag":
            counts[f"{frame.path} {value}"] += 1
        elif kind == "text" and (text := _clean(value)):
            key = f"{frame.path} #{xxhash.xxh3_64_hexdigest(text)}"
            counts[key] += 1
            if not frame.away:
                chars[key] += len(text)
                own[frame.path] += len(text)
    for path, n in own.items():
        chars[""] += n
        while path:
            above, _, segment = path.rpartition("/")
            chars[f"{path} {segment}"] += n
            path = above
    return {k: (n, chars[k]) for k, n in counts.items()}


def extract(page: str, slot: str | None, template: frozenset[str]) -> str:
    """Text of the main slot (of the whole page without one) less the template's text runs."""
    parts, main = parse(page)
    blocks: list[str] = []
    held: list[str] = []
    for kind, frame, value in parts:
        if kind == "block":
            if held and (text := _clean("".join(held))):
                blocks.append(text)
            held = []
        elif kind == "text" and not frame.away and (frame.main or not main) and (slot is None or f"{frame.path}/".startswith(f"{slot}/")):
            if not template or not (text := _clean(value)) or f"{frame.path} #{xxhash.xxh3_64_hexdigest(text)}" not in template:
                held.append(value)
    if held and (text := _clean("".join(held))):
        blocks.append(text)
    return "\n".join(blocks)


_SEEN = pa.schema([("host", pa.string()), ("path", pa.string()), ("mark", pa.string()), ("content", pa.int64()), ("n", pa.int64()), ("chars", pa.int64())])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = page_tokens(text or "")
                opened = sorted((key, n) for key, (n, chars) in tokens.items() if chars and " #" in key)
                content = xxhash.xxh3_64_intdigest(repr(opened)) - (1 << 63)
                for key, (n, chars) in tokens.items():
                    rows.append((host, *key.partition(" ")[::2], content, n, chars))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_SEEN)], schema=_SEEN)


def templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(at_host, slot, template array<string>) of each host with at least MIN_PAGES pages; written.

    A token is a path and a mark: `#digest` of a text run, else a tag.  The token without either occurs once on every page:
    its class is the root class.  Halves of 32 bits are summed, so a host may have four billion pages.  Tokens on fewer
    than MIN_PAGES pages go as soon as they are counted; a host's template is no longer than one of its pages.
    """
    seen = pages.select("host", "html").mapInArrow(_occurrences, "host string, path string, mark string, content long, n long, chars long")
    once = seen.groupBy("host", "path", "mark", "content").agg(F.min("n").alias("n"), F.max("chars").alias("chars")).withColumn("digest", F.xxhash64("content", "n"))
    vectors = once.groupBy("host", "path", "mark").agg(F.count(F.lit(1)).alias("pages"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("chars").alias("chars"),
                                                      F.struct(F.sum(F.shiftrightunsigned("digest", 32)).alias("high"), F.sum(F.col("digest").bitwiseAND(0xFFFFFFFF)).alias("low")).alias("vector"))
    vectors = keep(spark, vectors.where(F.col("pages") >= MIN_PAGES), "html-vectors")
    roots = keep(spark, vectors.where("mark = '' AND path = ''").select(F.col("host").alias("h"), F.col("pages").alias("all_pages"), F.col("chars").alias("open_chars")), "html-roots")
    on_host = F.col("host").eqNullSafe(F.col("h"))
    every_page = (F.col("pages") == F.col("all_pages")) & (F.col("least") == F.col("most"))
    name = F.substring_index("mark", ".", 1)
    tags = vectors.where((F.col("mark") != "") & (F.col("mark") == F.substring_index("path", "/", -1)))

    texts = vectors.where(F.startswith("mark", F.lit("#"))).join(sized(roots), on_host)
    opened = tags.select(F.col("host").alias("in_host"), F.col("path").alias("in_path"), F.col("vector").alias("tag_vector"))
    classed = texts.join(opened, F.col("host").eqNullSafe(F.col("in_host")) & (F.col("path") == F.col("in_path")), "left")  # one tag a path
    inside = F.rlike("path", F.lit(IN_MAIN))
    nested = F.coalesce(F.col("vector") == F.col("tag_vector"), F.lit(False))
    valid = F.when(inside, every_page & (F.col("pages") >= MIN_MAIN)).otherwise(every_page | nested)
    classed = keep(spark, classed.select("host", "path", "mark", "chars", "vector", inside.alias("inside"), every_page.alias("every"), nested.alias("nested"), valid.alias("valid")), "html-classed")
    beside = F.when(F.col("nested"), -F.col("chars")).otherwise(F.col("chars"))
    groups = classed.where("NOT inside AND NOT every AND chars > 0").groupBy("host", "vector").agg(F.sum(beside).alias("beside")).where("beside > 0")
    copies = keep(spark, groups.select(F.col("host").alias("g_host"), F.col("vector").alias("g_vector")), "html-copies")
    near = F.col("host").eqNullSafe(F.col("g_host")) & (F.col("vector") == F.col("g_vector")) & ~F.col("inside") & ~F.col("every")
    found = classed.where("valid").join(sized(copies), near, "left_anti")
    around = found.where("NOT inside").groupBy(F.col("host").alias("a_host")).agg(F.sum("chars").alias("around_chars")).join(sized(roots), F.col("a_host").eqNullSafe(F.col("h")))
    share = F.when(F.col("around_chars") > FEW * F.col("all_pages"), MAX_AROUND).otherwise(MAX_FEW)
    full_of = keep(spark, around.where(F.col("around_chars") > share * F.col("open_chars")).select("a_host"), "html-near-copies")
    found = found.join(sized(full_of), F.col("host").eqNullSafe(F.col("a_host")) & ~F.col("inside"), "left_anti")
    fixed = keep(spark, found.select("host", "path", "mark", "chars", "inside"), "html-fixed")

    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    closed = fixed.where("NOT inside AND chars > 0").select("host", "chars", F.explode(above).alias("path")).groupBy(F.col("host").alias("c_host"), F.col("path").alias("c_path")).agg(F.sum("chars").alias("closed"))
    closed = keep(spark, closed, "html-closed")

    def open_part(df: DataFrame, host: str, path: Column, chars: str) -> DataFrame:
        found = df.join(sized(closed), F.col(host).eqNullSafe(F.col("c_host")) & (F.col("c_path") == path), "left")
        return found.withColumn(chars, F.col(chars) - F.coalesce("closed", F.lit(0))).drop("c_host", "c_path", "closed")

    left = keep(spark, open_part(roots, "h", F.lit(""), "open_chars"), "html-left")
    boxes = tags.where(name.isin(*BOXES)).join(sized(left), on_host).where(every_page & (F.col("most") == 1))
    boxes = open_part(boxes, "host", F.col("path"), "chars").where((2 * F.col("chars") >= F.col("open_chars")) & (F.col("chars") > 0))
    order = F.struct(name.isin("article", "main"), F.size(parts), "path")
    slots = boxes.groupBy(F.col("host").alias("box_host")).agg(F.max_by("path", order).alias("slot"))

    token = F.concat_ws(" ", "path", "mark")
    found = fixed.groupBy(F.col("host").alias("text_host")).agg(F.collect_set(F.when(~F.col("inside"), token)).alias("around"), F.collect_set(F.when(F.col("inside"), token)).alias("within"),
                                                               F.sum(F.when(F.col("inside"), F.col("chars")).otherwise(0)).alias("within_chars"))
    full = left.join(slots, F.col("h").eqNullSafe(F.col("box_host")), "left").join(found, F.col("h").eqNullSafe(F.col("text_host")), "left")
    whole = F.when(F.col("open_chars") <= 0, F.lit(None)).when(F.col("within_chars") <= MAX_SHARE * F.col("open_chars"), F.concat("around", "within")).otherwise(F.col("around"))
    return keep(spark, full.select(F.col("h").alias("at_host"), "slot", F.coalesce(whole, F.array().cast("array<string>")).alias("template")), "html-templates")


def main_texts(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = templates(spark, pages)
    joined = pages.join(sized(found), F.col("host").eqNullSafe(F.col("at_host")), "left").select("page_id", "url", "html", "slot", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, frozenset()
        for batch in batches:
            texts = []
            for page, slot, template in zip(batch.column(2), batch.column(3), batch.column(4)):
                value = template.as_py() or []
                if value != last:
                    last, known = value, frozenset(value)
                texts.append(extract(page.as_py() or "", slot.as_py(), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = StructType([pages.schema["page_id"], StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark, table(spark, sf_dir, "pages"))
