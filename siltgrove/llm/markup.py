"""Markup residue in text: which kinds of markup a text holds, and its clean text with the structure kept.

A text goes through the standard library's streaming parser once. Its events (tags, character references, comments)
tell whether there is HTML; build lines with their amounts of text, of link text and of tags; and give the text between
them, in which a tokenizer finds the marks of LaTeX, wiki and Markdown, one after the other, each in what the last ones
left. The text-to-tag ratio of the lines is smoothed by a Gaussian and cut at a threshold found by two-means
clustering; lines below it that are mostly links are left out as page furniture. Headings, lists, code, tables and
formulas keep a plain notation: `# `, `- `, fences, ` | ` between cells, and `$…$`.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

FIELDS = ("html", "latex", "table_body")

#: Names of HTML tags and LaTeX commands, and how commands are written in plain text.
TAGS = "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
COMMANDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega Gamma Delta Theta Lambda Sigma Phi Psi Omega frac dfrac tfrac sqrt sum prod int lim infty partial nabla cdot times div pm leq geq le ge neq ne approx equiv sim to in subset cup cap forall exists ldots cdots dots mathbf mathrm mathit mathcal mathbb text textbf textit textrm texttt emph underline section subsection subsubsection paragraph item begin end label ref cite footnote hline cline multicolumn left right quad qquad caption centering title author maketitle"
SYMBOLS = {"leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "cdot": "·", "times": "×", "approx": "≈", "infty": "∞", "ldots": "…", "dots": "…"}

_NAMES = frozenset(TAGS.split())
#: Tags after which a new line of text begins.
_BREAKS = frozenset("p br d div dl dt dd li tr table tbody thead tfoot td th title tt textarea h h1 h2 h3 h4 h5 h6 head header hr html label link".split())
_ESCAPED = re.compile(rf"&lt;/?(?:{'|'.join(sorted(_NAMES, key=len, reverse=True))})\b", re.I)
_CMD = "|".join(sorted(COMMANDS.split(), key=len, reverse=True))
_MATH = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\$(?! )(?:[^$\n]{0,300}?(?:\\|[\^_=]|[A-Za-z]))[^$\n]{0,300}?(?<! )\$|\$ ?[^$\n]*\\[A-Za-z][^$\n]*\$", re.S)
_ENV = re.compile(r"\\begin\{(\w+\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_COMMAND = re.compile(rf"\\(?:{_CMD})(?![A-Za-z])|\\[A-Za-z]{{2,}}\s*\{{|\\[a-zA-Z]+\*?\[")
_TEX_BITS = re.compile(rf"\\(?:{_CMD})(?![A-Za-z])(?:\s*(?:\[[^\]]*\]|\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}}))*")
_WIKI = re.compile(r"\[\[[^\[\]\n]+\]\]|(?<![\\{A-Za-z^_])\{\{\s*[^\W\d_][^{}]*\}\}|''(?!').+?''|^(={2,6})[^=\n].*?\1[ \t]*$|^\{\|.*$|^\|-[ \t]*$|^\|\}[ \t]*$|^!.*!!.*$|\[https?://\S+ [^\]]+\]|^:{1,4}\s?\S|__[A-Z]{3,}__", re.M)
_MD_STRONG = re.compile(
    r"\*\*[^*\s][^*]*\*\*|(?<!\w)__[^_\s][^_]*__(?!\w)|^```|^~~~|(?<!`)`[^`\n]+`(?!`)|!?\[[^\[\]\n]*\]\((?!\s)[^()\n]*\)|^>\s?\S"
    r"|(?<![\w_])_[^_\s][^_\n]*[^_\s]_(?![\w_])|(?<![\w*])\*[^*\s][^*\n]*[^*\s]\*(?![\w*])|~~[^~\n]+~~"
    r"|^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[^\n|\-=][^\n]*\n(?:={3,}|-{3,})[ \t]*$|^\[[^\]\n]+\]:\s*\S+|^ {0,3}(?:\* ?){3,}$",
    re.M,
)
_MD_HEADING = re.compile(r"^#{1,6} +\S", re.M)
_BULLET = re.compile(r"^[ \t]*[-*+] +\S", re.M)
_NUMBERED = re.compile(r"^[ \t]*\d{1,3}[.)] +\S", re.M)


def marks(text: str, html_found: bool) -> list[tuple[str, str]]:
    """Events of the marks in a text without tags, as (kind, what): kind is latex, wiki, markdown or shared, for lists
    and headings that wiki and Markdown write alike. LaTeX is taken out before wiki is looked for, wiki before
    Markdown, so that a mark counts for one kind."""
    out: list[tuple[str, str]] = []
    rest = re.sub(r"^[ \t]+(?=[^-*+\d \t])", "", text, flags=re.M) if html_found else text

    def formula(m: str) -> bool:
        return "\\" in m or bool(re.search(r"[\^_]\{?\w|=", m)) and not re.search(r"\s\w{3,}\s", m)

    tex = [("latex", "formula") for m in _MATH.findall(rest) if formula(m)]
    tex += [("latex", "environment") for _ in _ENV.finditer(rest)] + [("latex", "command") for _ in _COMMAND.finditer(rest)]
    if tex:
        out += tex
        rest = _MATH.sub(lambda m: " " if formula(m[0]) else m[0], _ENV.sub(" ", rest))
        rest = re.sub(r"[_^](?:\{[^{}]*\}|[A-Za-z0-9])", " ", _TEX_BITS.sub(" ", rest))
    rest = re.sub(r"```.*?(?:```|\Z)", "```", rest, flags=re.S | re.M)
    wiki = [("wiki", "mark") for _ in _WIKI.finditer(rest)]
    out += wiki
    out += [("shared", "bullet") for _ in _BULLET.finditer(rest)] + [("shared", "number") for _ in _NUMBERED.finditer(rest)]
    out += [("shared", "heading" if m[0].startswith("# ") else "deep heading") for m in _MD_HEADING.finditer(rest)]
    out += [("markdown", "mark") for _ in _MD_STRONG.finditer(_WIKI.sub(" ", rest) if wiki else rest)]
    return out


def kinds(parsed: "_Lines") -> list[str]:
    """The kinds of markup that a parse and the marks in its text show: of html, latex, markdown and wiki. Marks that
    wiki and Markdown share count for wiki where there is other wiki markup, else for Markdown; a single one is none."""
    seen = [kind for kind, _ in parsed.events]
    found = marks("".join(parsed.rest), bool(seen))
    n = Counter(found)
    out = {kind for kind, _ in found} - {"shared"} | ({"html"} if seen else set())
    lists = n["shared", "bullet"] >= 2 or n["shared", "number"] >= 2
    if "wiki" not in out and (lists or n["shared", "heading"] or n["shared", "deep heading"]):
        out.add("markdown")
    return sorted(out)


_BLOCKS = frozenset("p div section article main header footer nav aside blockquote ul ol dl table tr h1 h2 h3 h4 h5 h6 pre form figure figcaption caption li dt dd hr br".split())
_SKIP = frozenset(("script", "style", "noscript", "iframe", "head"))


class _Lines(HTMLParser):
    """Lines of text with their amounts of text, link text and tags, built while events stream by."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.lines: list[list] = []  # text, characters, characters in links, tags, structural
        self.events: list[tuple[str, str]] = []  # tags, references and comments, by kind and name
        self.rest: list[str] = []  # the text between them
        self.starts: list[int] = [0]  # of the lines of the text that is fed
        self.now: list = ["", 0, 0, 0, False]
        self.skip = self.link = self.pre = 0
        self.cells: list[str] | None = None
        self.lists: list[list] = []

    def between(self, tag: str) -> None:
        self.rest.append("\n" if tag in _BREAKS else " ")

    def handle_charref(self, name: str) -> None:
        self.reference("#" + name)

    def handle_entityref(self, name: str) -> None:
        self.reference(name)

    def reference(self, name: str) -> None:
        """A character reference, or the text as it stands where it is none."""
        closed = self.rawdata.startswith(f"&{name};", self.at())
        known = closed and (name[0] == "#" and len(name) > 2 or f"{name};" in html5 and len(name) > 1)
        if known:
            self.events.append(("reference", name))
        text = html.unescape(f"&{name};") if known else f"&{name}" + (";" if closed else "")
        self.rest.append(text)
        self.words(text)

    def at(self) -> int:
        """Where in the text the event being handled began: the text is fed whole."""
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_comment(self, data: str) -> None:
        self.events.append(("comment", ""))
        self.rest.append(" ")

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.events.append(("declaration", ""))
            self.rest.append(" ")
        else:
            self.handle_data(f"<!{decl}>")

    def end_line(self) -> None:
        if self.now[0].strip():
            self.now[0] = self.now[0] if self.pre else re.sub(r"[ \t\n]+", " ", self.now[0]).strip()
            self.lines.append(self.now)
            self.now = ["", 0, 0, 0, False]
        else:
            self.now[0], self.now[4] = "", False

    def end_row(self) -> None:
        if self.cells is not None:
            if any(c.strip() for c in self.cells):
                cells = " | ".join(re.sub(r"\s+", " ", c).strip() for c in self.cells)
                self.lines.append([cells, len(cells), 0, 1, True])
            self.cells = None

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag not in _NAMES:
            self.handle_data(self.get_starttag_text() or f"<{tag}>")
            return
        self.events.append(("tag", tag))
        self.between(tag)
        self.now[3] += 1
        if tag in _SKIP:
            self.skip += tag not in ("head",)
        elif tag in ("td", "th"):
            self.cells = [] if self.cells is None else self.cells
            self.cells.append("")
        elif tag in ("tr", "table"):
            self.end_row()
            self.end_line()
        elif tag in ("sub", "sup"):
            self.put("^" if tag == "sup" else "_")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in _BLOCKS and self.cells is not None:
            self.put(" ")
        elif tag in _BLOCKS:
            self.end_line()
            if tag[0] == "h" and tag[1:].isdigit():
                self.now[0], self.now[4] = "#" * int(tag[1:]) + " ", True
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li":
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.now[0], self.now[4] = (f"{kind[1]}. " if kind[0] == "ol" else "- "), True
            elif tag == "pre":
                self.lines.append(["```", 0, 0, 0, True])
                self.pre += 1
        elif tag == "a":
            self.link += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in _NAMES:
            self.handle_data(f"</{tag}>")
            return
        self.events.append(("tag", "/" + tag))
        self.between(tag)
        self.now[3] += 1
        if tag in _SKIP:
            self.skip = max(0, self.skip - (tag not in ("head",)))
        elif tag in ("tr", "table", "tbody", "thead"):
            self.end_row()
            self.end_line()
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in _BLOCKS and self.cells is None:
            if tag == "pre" and self.pre:
                self.end_line()
                self.pre -= 1
                self.lines.append(["```", 0, 0, 0, True])
            self.end_line()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag == "a":
            self.link = max(0, self.link - 1)

    def put(self, data: str) -> None:
        if self.cells is not None and self.cells:
            self.cells[-1] += data
        else:
            self.now[0] += data

    def handle_data(self, data: str) -> None:
        self.rest.append(data)
        self.words(data)

    def words(self, data: str) -> None:
        if self.skip:
            return
        if self.cells is None and (self.pre or "\n" in data):
            # Lines of the source outside of blocks stay lines: other kinds of markup need them.
            first, *rest = data.split("\n")
            self.put(first)
            self.count(first)
            for r in rest:
                blank = not self.now[0].strip() and self.lines and self.lines[-1][0]
                self.end_line()
                if blank and not self.pre:
                    self.lines.append(["", 0, 0, 0, True])
                self.put(r)
                self.count(r)
        else:
            self.put(data)
            self.count(data)

    @classmethod
    def of(cls, text: str) -> "_Lines":
        """The whole text's events. Escaped tags are read as tags."""
        for _ in range(2):
            if _ESCAPED.search(text):
                text = html.unescape(text)
        p = cls()
        if "<" in text or "&" in text:
            p.starts = [0, *(m.end() for m in re.finditer("\n", text))]
            p.feed(text)
            p.finish()
        else:  # no event can be in it
            p.rest.append(text)
        return p

    def count(self, data: str) -> None:
        n = len(data.strip())
        self.now[1] += n
        self.now[2] += n if self.link else 0

    def finish(self) -> None:
        self.close()
        self.end_row()
        self.end_line()


def content_lines(lines: list[list], sigma: float = 1.5) -> list[str]:
    """The lines of content regions: the smoothed text-to-tag ratios are clustered into two by two-means; a line of
    the low cluster is left out if links make up most of its text and the clusters stand well apart."""
    ratio = [x[1] / max(1, x[3]) for x in lines]
    reach = int(3 * sigma)
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for k in range(len(ratio)):
        s = w = 0.0
        for j, g in zip(range(k - reach, k + reach + 1), weights):
            if 0 <= j < len(ratio):
                s, w = s + g * ratio[j], w + g
        smooth.append(s / w)
    if not smooth:
        return []
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        cut = (low + high) / 2
        a, b = [x for x in smooth if x <= cut], [x for x in smooth if x > cut]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    cut = (low + high) / 2
    apart = high > 3 * low + 1
    return [x[0] for x, s in zip(lines, smooth) if not (apart and s <= cut and x[1] and x[2] > 0.6 * x[1])]


def from_html(parsed: _Lines) -> str:
    """The content lines of a parse with tags; of one with references only, the text as it is."""
    if not any(kind != "reference" for kind, _ in parsed.events):
        return "".join(parsed.rest).replace("\xa0", " ")
    return "\n".join(content_lines(parsed.lines)).replace("\xa0", " ")


def from_latex(text: str) -> str:
    def table(m: re.Match) -> str:
        rows = re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m[2]))
        return "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in rows if r.strip())

    text = re.sub(r"\\begin\{(tabular|array|longtable)\*?\}(?:\{[^{}]*\})?(.*?)\\end\{\1\*?\}", table, text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|gather|multline|displaymath|math)\*?\}(.*?)\\end\{\1\*?\}", lambda m: "$" + re.sub(r"\s*\\\\\s*", " ; ", m[2].replace("&", "").strip()) + "$", text, flags=re.S)
    text = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", r"```\1```", text, flags=re.S)
    text = re.sub(r"\\(section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * (1 + ("section", "subsection", "subsubsection", "paragraph").index(m[1])) + " " + m[2] + "\n", text)
    text = re.sub(r"\\item(?:\[[^\]]*\])?\s*", "\n- ", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}|\\(?:label|ref|cite)\{[^{}]*\}|\\(?:hline|centering|maketitle)", "", text)
    text = re.sub(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$", lambda m: "$" + (m[1] or m[2] or m[3]).strip() + "$", text, flags=re.S)
    for _ in range(4):
        text = re.sub(r"\\(?:text\w*|emph|underline|mathrm|mathbf|mathit|mathcal|mathbb|caption|title|author|footnote)\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([A-Za-z]+)(?![A-Za-z])", lambda m: SYMBOLS.get(m[1], m[0]), text)
    return text


def from_wiki(text: str) -> str:
    text = re.sub(r"^(?:\{\||\|\}|\|-).*(?:\n|\Z)|^\|\+", "", text, flags=re.M)
    text = re.sub(r"^[!|]\s*(.*)$", lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m[1]), text, flags=re.M)
    text = re.sub(r"^[*#:]+\s*(?=\S)", "- ", text, flags=re.M)  # lists first: headings get marks like theirs
    text = re.sub(r"^(={2,6})\s*(.*?)\s*\1[ \t]*$", lambda m: "#" * (len(m[1]) - 1) + " " + m[2], text, flags=re.M)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\{\{\s*([^{}|]*)\|?([^{}]*)\}\}", lambda m: re.sub(r"\s*\|\s*", " ", m[2]).strip() or m[1], text)
    text = re.sub(r"\[https?://\S+ ([^\]]+)\]", r"\1", text)
    return re.sub(r"'{2,5}", "", text)


def from_markdown(text: str) -> str:
    parts = re.split(r"(```.*?(?:```|\Z))", text, flags=re.S)
    for k in range(0, len(parts), 2):
        t = parts[k]
        t = re.sub(r"^([^\n]+)\n={3,}[ \t]*$", r"# \1", t, flags=re.M)
        t = re.sub(r"^([^\n|]+)\n-{3,}[ \t]*$", r"## \1", t, flags=re.M)
        t = re.sub(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*\n?", "", t, flags=re.M)
        t = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|?[ \t]*$", lambda m: re.sub(r"\s*\|\s*", " | ", m[1]), t, flags=re.M)
        t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", t)
        t = re.sub(r"(\*\*|__|~~)(\S.*?)\1", r"\2", t, flags=re.S)
        t = re.sub(r"(?<![\w_*])([_*])(\S[^\n_*]*?)\1(?![\w_*])", r"\2", t)
        t = re.sub(r"^>[ \t]?", "", t, flags=re.M)
        parts[k] = re.sub(r"^[ \t]*[*+-][ \t]+", "- ", t, flags=re.M)
    return "".join(parts)


def clean(text: str) -> tuple[str, list[str]]:
    """The clean text and the kinds of markup that were in it."""
    parsed = _Lines.of(text)
    found = kinds(parsed)
    if "html" in found:
        text = from_html(parsed)
    if "latex" in found:
        text = from_latex(text)
    if "wiki" in found:
        text = from_wiki(text)
    if "markdown" in found:
        text = from_markdown(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip(), found


def _parsed(content: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """item_id, field_name, text and markup of every field where it lies, repeated rows included."""
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw")) for f in fields])).alias("x")
    rows = content.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), every).select("item_id", "x.field_name", "x.raw").where("raw is not null")

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            got = [clean(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["item_id", "field_name", "text", "markup"])

    return spread(rows).mapInArrow(run, "item_id long, field_name string, text string, markup array<string>")


def found(content: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """item_id, field_name and each kind of markup in the field, once; only these go through a shuffle."""
    return _parsed(content, fields).select("item_id", "field_name", F.explode("markup").alias("markup")).distinct()


def cleaned(content: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """item_id, field_name, text (clean) and markup (kinds, sorted; empty if there is none) of every non-null field.

    Null fields and null item ids give no row, empty ones empty text without markup; whole texts are parsed, however
    long, unclosed or nested. Repeated rows count once: they are parsed where they lie and dropped by key after. Other
    columns are left aside.
    """
    return _parsed(content, fields).dropDuplicates(["item_id", "field_name"])
