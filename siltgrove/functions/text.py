"""Scalar text functions as Column expressions: they stay on the JVM side and inside whole-stage code."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that answers are compared without, what transcripts mark up, items that are furniture of a
# page, forms of a conversation before a question, marks of a context's origin.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TRANSCRIPT = (
    ("{vocalsound}", ""), ("{disfmarker}", ""), ("A_M_I_", "ami"), ("L_C_D_", "lcd"), ("P_M_S", "pms"),
    ("T_V_", "tv"), ("{pause}", ""), ("{nonvocalsound}", ""), ("{gap}", ""), ("  ", " "),
)
LAYOUT_TYPES = ("header", "footer", "page_number", "aside_text", "page_footnote", "seal")
HISTORY, CURRENT = "Conversation history:\n", "\n\nCurrent question: "
OF_LAYER, OF_LEAF = "[LAYER: ", "[ID: "
# End of fixed values.

SPACE = "[ \\t\\n\\r\\u000B\\f]+"


def literal_replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def collapse(text: Column) -> Column:
    """Runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation deleted, articles dropped, white space collapsed, in this order."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, "\\b(a|an|the)\\b", " "))


def title_body(title: Column, body: Column) -> Column:
    """Title, line feed, body. Null if either is null."""
    return F.concat(title, F.lit("\n"), body)


def clean_transcript(text: Column) -> Column:
    """A transcript without its marks: the replacements once each, in order."""
    for old, new in TRANSCRIPT:
        text = literal_replace(text, old, new)
    return text


def flatten_transcript(turns: Column) -> Column:
    """Turns (speaker, content) as lines, cleaned."""
    lines = F.transform(turns, lambda t: F.concat(F.lit("Speaker: "), t["speaker"], F.lit("\nContent: "), t["content"]))
    return clean_transcript(F.array_join(lines, "\n"))


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; null for null."""
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r\\u000B\\f]+"))


def node_text(texts: Column) -> Column:
    """Texts of children for an abstract: line feeds as blanks, an empty line after each."""
    return F.array_join(F.transform(texts, lambda t: F.concat(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\n\n"))), "")


def parse_response(response: Column) -> Column:
    """Struct (thought, action, payload) of an agent's response: the last `Retrieve: ` wins, else the last `Answer: `;
    without either, the answer `Error`."""

    def part(mark: str, action: str) -> Column:
        n = F.length(response) - F.length(F.substring_index(response, mark, -1)) - len(mark)
        thought = F.regexp_replace(F.substring(response, F.lit(1), n), "^\\n+|\\n+$", "")
        payload = F.regexp_replace(F.substring_index(response, mark, -1), "[ .]+$", "")
        return F.struct(thought.alias("thought"), F.lit(action).alias("action"), payload.alias("payload"))

    none = F.struct(F.lit("").alias("thought"), F.lit("answer").alias("action"), F.lit("Error").alias("payload"))
    return F.when(F.contains(response, F.lit("Retrieve: ")), part("Retrieve: ", "retrieve")).when(F.contains(response, F.lit("Answer: ")), part("Answer: ", "answer")).otherwise(none)


def parse_answer(response: Column) -> Column:
    """What follows the last `Answer:` without blanks and full stops around; without the mark, the whole text."""
    tail = F.when(F.contains(response, F.lit("Answer:")), F.substring_index(response, "Answer:", -1)).otherwise(response)
    return F.regexp_replace(tail, "^[ .]+|[ .]+$", "")


def safe_name(name: Column) -> Column:
    """A name for files: characters that file systems refuse as _, white space collapsed, no blank or dot at the end."""
    return F.regexp_replace(collapse(F.regexp_replace(name, '[<>:"/\\\\|?*]', "_")), "[ .]+$", "")


def unescape(text: Column) -> Column:
    """Character entities written out: numeric ones of the Latin range by table, the named ones that HTML 4 has, and
    `&amp;` last."""
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")):
        text = literal_replace(text, name, value)
    return text


def plain(text: Column) -> Column:
    """Markup out of a text: entities written out first, then tags as blanks, then white space collapsed (no-break
    spaces too). Null gives empty text."""
    bare = F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r\\u000B\\f\\u00A0]+", " "))


def joined_parts(*parts: Column) -> Column:
    """The non-empty parts, one per line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def item_text(kind: Column, c) -> Column:  # noqa: ANN001
    """The text of a parsed PDF's item by its type; empty for furniture of the page. c gives the columns by name."""
    text = plain(c("text"))
    level = F.coalesce(c("text_level"), F.lit(0))
    heading = F.when((text != "") & (level > 0), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    listed = F.array_join(F.filter(F.concat(F.array(text), F.transform(F.coalesce(c("list_items"), F.array().cast("array<string>")), plain)), lambda p: p != ""), "\n")
    return (
        F.when(kind.isin(*LAYOUT_TYPES), "")
        .when(kind == "text", heading)
        .when(kind == "list", listed)
        .when(kind == "equation", joined_parts(text, plain(c("latex")), plain(c("html"))))
        .when(kind == "code", joined_parts(plain(c("code_caption")), plain(c("code_body"))))
        .when(kind == "table", joined_parts(*(plain(c(x)) for x in ("table_caption", "table_body", "table_footnote", "html"))))
        .when(kind.isin("image", "chart"), joined_parts(plain(c("image_caption")), plain(c("chart_caption"))))
        .otherwise(joined_parts(text, plain(c("content")), plain(c("latex")), plain(c("html"))))
    )


def history(turns: Column, question: Column) -> Column:
    """Turns (role, content) before a question as one prompt; the question alone without turns."""
    lines = F.transform(turns, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"]))
    text = F.concat(F.lit(HISTORY), F.array_join(lines, "\n"), F.lit(CURRENT), question)
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, question).otherwise(text)


def annotated(text: Column, layer: Column, node_id: Column, has_children: Column) -> Column:
    """A context text with where it is from: its layer for inner nodes, its id for leaves."""
    mark = F.when(has_children, F.concat(F.lit(OF_LAYER), layer.cast("string"), F.lit("] "))).otherwise(F.concat(F.lit(OF_LEAF), node_id.cast("string"), F.lit("] ")))
    return F.concat(mark, text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^ \\t\\n\\r\\u000B\\f]+"), F.lit(0))


def short_text(text: Column, most: int = 20) -> Column:
    """A text of at most most words, or its head and ` ...`."""
    w = words(text)
    return F.when(F.size(w) <= most, text).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit(" ...")))


def truncated(text: Column, most: int, tail: int = 50) -> Column:
    """A text of at most most words, or its head and its tail with `...` between."""
    tail = min(tail, most - 1)
    w = words(text)
    cut = F.concat(F.array_join(F.slice(w, 1, most - tail), " "), F.lit("\n...\n"), F.array_join(F.slice(w, -tail, tail), " ") if tail else F.lit(""))
    return F.when(F.size(w) <= most, text).otherwise(cut)


def id_list(ids: Column) -> Column:
    """Ids as text; of more than a hundred the first 95 and the last 5."""
    s = F.transform(ids, lambda i: i.cast("string"))
    return F.array_join(F.when(F.size(s) <= 100, s).otherwise(F.concat(F.slice(s, 1, 95), F.array(F.lit("...")), F.slice(s, -5, 5))), ", ")


def terms(text: Column) -> Column:
    """Search terms: lower-cased words of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def answer_tokens(text: Column) -> Column:
    """The words of a normalised answer; none for an empty one."""
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")
