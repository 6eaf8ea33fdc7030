"""Broken prompt and response pairs: each defective reply with the one type of its defect.

The payload of a response is aligned with its prompt by shingle containment and longest common subsequence (copies),
and with templates of refusals (refusals). Most of what tells defects is learned from the tables: refusal templates are
replies that recur under prompts with which they share nothing; how a text may end, and what is a word, from the log's
own sentences; languages from rows that name theirs. Frames of first-person refusals help where a log is too small to
show templates. One pass over the log counts, one applies; the templates that the latter doesn't hold in memory are
joined to the replies by shingles.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import lcs
from ..session import written
from . import language

DEFECTS = ("empty", "refusal", "copy", "truncated", "wrong_language")

#: Words that introduce a copied question.
LABELS = frozenset("question the is was asked you q frage die war lautet gefragt la demande était est pregunta era es subquestion domanda vraag".split())
#: Frames of a refusal, by language: who speaks; what denies; what is denied. One of each within REACH words, or a
#: speaker with a word of turning down. The last two are beginnings of words.
FRAMES = {
    "en": ("i|we", "not|t|cannot|unable|never", "help|assist|answer|respon|reply|provid|giv|shar|compl|support|discuss|fulfil|process|handl|disclos|address|comment|engage|tell|say", "declin|refus|abstain|refrain|reject"),
    "fr": ("je|j|m|me|nous", "pas|ne|impossible|incapable|aucun|aucune", "aid|répon|trait|fourni|donn|assist|partag|communiqu|renseign|satisf|suite", "refus|déclin"),
    "de": ("ich|mir|wir|uns", "nicht|kein|keine|keinen|keiner|keinerlei|unmöglich", "beantwort|antwort|helfen|weiterhelf|hilfe|auskunft|auskünft|unterstütz|bearbeit|mitteil|angaben|behilflich|nachkomm|sagen", "ablehn|lehne|verweiger"),
    "es": ("puedo|podré|debo|me|estoy|soy|podemos", "no|imposible|incapaz", "respond|ayud|contest|dar|proporcion|ofrec|asist|atend|facilit|respuesta", "rechaz|negarme|declin"),
    "it": ("posso|potrò|devo|mi|sono", "non|impossibile", "rispond|aiut|forni|assist|dare|soddisf|risposta", "rifiut|declin"),
    "pt": ("posso|consigo|devo|me|sou", "não|impossível", "respond|ajud|fornec|atend|dar|resposta", "recus"),
    "nl": ("ik|mij|wij", "niet|geen|onmogelijk", "beantwoord|antwoord|help|geven|verstrekk|bijstaan", "weiger|afwijz"),
}
REACH = 12
#: Prompts under which a reply recurs, and its least and greatest number of words, to count as a template of
#: refusals; templates, commonest first, that the scan of a log holds in memory (all others are joined).
RECURS, SHORT, LONG, TEMPLATES = 3, 4, 40, 4096
#: Words of the log, commonest first, whose ways to end are kept; occurrences they need; share of ends up to which a
#: word needs another one after it.
WORDS, SEEN, GOES_ON = 20_000, 20, 0.01
#: Words of the payload that tell a language, at least; how much likelier, in log probability per feature and in all,
#: the other language must be.
PLAIN, CLEARER, SURER = 4, 0.35, 12.0

_TOKEN = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")
_ENDS = re.compile(r"[.!?…。]['\"”»’)\]]*$")
_LAST_WORD = re.compile(r"([^\W\d_]+)[\s'\"”»’)\]]*$")
_FRAMES = [(frozenset(who.split("|")), re.compile(no), re.compile(rf"(?:{what})"), re.compile(rf"(?:{down})")) for who, no, what, down in FRAMES.values()]


def tokens(text: str) -> list[str]:
    """Longest runs of letters and digits, lower-cased, in composed form."""
    return _TOKEN.findall(unicodedata.normalize("NFC", text).lower())


def payload(response: str) -> str | None:
    """What follows the last `Retrieve: `, else the last `Answer: `; None without either."""
    for mark in ("Retrieve: ", "Answer: "):
        if mark in response:
            return response.rsplit(mark, 1)[1]
    return None


@dataclass
class Model:
    """What the tables teach: templates of refusals by their shingles, words with their shares of ends, languages. As
    defects() makes it, its size is bounded by TEMPLATES, WORDS and the languages' buckets."""

    templates: list[list[str]] = field(default_factory=list)
    ends: dict[str, float] = field(default_factory=dict)
    languages: language.Languages = field(default_factory=language.Languages)

    def __post_init__(self) -> None:
        self.at: dict[tuple[str, ...], list[int]] = {}
        for k, t in enumerate(self.templates):
            for s in set(zip(t, t[1:], t[2:])):
                self.at.setdefault(s, []).append(k)
        self.sorted = sorted(self.ends)

    def begins_word(self, part: str) -> bool:
        """Whether part is the beginning of a known word and none itself."""
        k = bisect.bisect_left(self.sorted, part)
        return part not in self.ends and k < len(self.sorted) and self.sorted[k].startswith(part)


def framed(words: list[str]) -> bool:
    """Whether someone says of themselves that they don't reply: one of FRAMES within REACH words."""
    for who, no, what, down in _FRAMES:
        for k in (k for k, w in enumerate(words) if w in who):
            near = words[max(0, k - 4) : k + REACH]
            if any(down.match(w) for w in near) or any(no.fullmatch(w) for w in near) and any(what.match(w) for w in near):
                return True
    return False


def refusable(response: str) -> list[str]:
    """The words of a response, or of its payload if it has one, that may decline: those outside quotations."""
    given = payload(response)
    return tokens(_QUOTED.sub(" ", response if given is None else given))


def holds(words: list[str], template: list[str], shared: int) -> bool:
    """Whether the words, with so many of the template's shingles, contain it: four fifths of the shingles, and nearly
    all of its words in order."""
    return shared >= 0.8 * (len(template) - 2) and lcs(template, words) >= len(template) - (len(template) > 5)


def is_refusal(words: list[str], model: Model) -> bool:
    """Whether the words contain a refusal: a template, or a frame."""
    hits: dict[int, int] = {}
    for s in set(zip(words, words[1:], words[2:])):
        for k in model.at.get(s, ()):
            hits[k] = hits.get(k, 0) + 1
    return any(holds(words, model.templates[k], n) for k, n in hits.items()) or framed(words)


def is_copy(asked: list[str], given: list[str]) -> bool:
    """Whether the given words only say the asked ones back, once or more often, perhaps after a label."""
    if len(asked) < 3 or not given:
        return False
    own = {tuple(asked[k : k + 3]) for k in range(len(asked) - 2)}
    there = {tuple(given[k : k + 3]) for k in range(len(given) - 2)}
    if len(own & there) < 0.8 * len(own) or lcs(asked, given) < 0.9 * len(asked):
        return False
    known = set(asked)
    return all(t in known or t in LABELS for t in given)


def is_truncated(text: str, model: Model) -> bool:
    """Whether a payload breaks off: it is no short answer, has no end mark, and ends within a bracket or quotation,
    with a mark or word that needs something after it, within a word, or after more words than an unpunctuated answer
    has."""
    text = text.rstrip()
    if _ENDS.search(text):
        return False
    words = tokens(text)
    if len(words) < 5:
        return False
    if any(text.count(a) > text.count(b) for a, b in (("(", ")"), ("[", "]"), ("“", "”"), ("«", "»"))) or text.count('"') % 2:
        return True
    plain = tokens(_QUOTED.sub(" ", text))
    if text.endswith((",", ";", ":", "-")):
        return True
    last = _LAST_WORD.search(text)
    if last and last[1].islower() and not text.endswith((")", "]", '"', "”", "»")):
        if model.ends.get(last[1], 1.0) <= GOES_ON or model.begins_word(last[1]):
            return True
    if text.endswith((")", "]", '"', "”", "»")):
        return False
    return len(plain) >= 13


def is_foreign(asked: str, given: str, model: Model) -> bool:
    """Whether the given text is sentences of another language than the asked one."""
    theirs, ours = language.plain_words(given), language.plain_words(asked)
    if len(theirs) < PLAIN or len(ours) < 2 or not model.languages.names:
        return False
    mine = int(model.languages.scores(ours)[:-1].argmax())
    *scores, n = model.languages.scores(theirs)
    gain = max(scores) - scores[mine]
    return gain >= CLEARER and gain * n >= SURER


def defect(prompt: str | None, response: str | None, model: Model) -> str | None:
    """The one defect of a reply, or None."""
    if response is None or not _TOKEN.search(response):
        return "empty"
    given = payload(response)
    if given is None:
        return "refusal" if is_refusal(refusable(response), model) else "truncated"
    words = tokens(given)
    if not words:
        return "empty"
    asked = tokens(prompt or "")
    if is_refusal(refusable(response), model):
        return "refusal"
    if is_copy(asked, words):
        return "copy"
    # A question said back, a colon and a short answer are no break.
    head, _, tail = given.rpartition(":")
    said = len(tokens(head)) >= 5 and 1 <= len(tokens(tail)) <= 4
    if not said and is_truncated(given, model):
        return "truncated"
    return "wrong_language" if is_foreign(prompt or "", _QUOTED.sub(" ", given), model) else None


def _recurring(rows: DataFrame) -> DataFrame:
    """The replies that recur under RECURS prompts and more and share no word of four letters with them, as their words
    (reply), each with the number of the prompts (n)."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                given = payload(r)
                words = tokens(r if given is None else given)
                if SHORT <= len(words) <= LONG and not {w for w in words if len(w) > 3} & set(tokens(p)):
                    out.append((" ".join(words), p))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["reply", "prompt"])

    said = rows.where("prompt is not null and response is not null").select("prompt", "response").mapInArrow(run, "reply string, prompt string")
    return said.select("reply", F.xxhash64("prompt").alias("p")).distinct().groupBy("reply").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS)


def _ends(rows: DataFrame) -> dict[str, float]:
    """The commonest words of prompts and responses, without capitals, with the share of their occurrences that end a
    sentence. A text's last word counts as an end: few texts break off, and those do at any word."""
    texts = rows.select(F.explode(F.array("prompt", "response")).alias("t")).where("t is not null").select(F.concat(F.rtrim("t"), F.lit(".")).alias("t"))
    found = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?U)(?<![\p{L}\p{N}])(\p{Ll}+(?:[.!?…]|(?![\p{L}\p{N}])))"), 1)).alias("w"))
    word = F.regexp_replace("w", "[.!?…]$", "")
    counts = found.groupBy(word.alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w") != word).alias("e")).where(F.col("n") >= SEEN)
    return {r.word: r.e / r.n for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()}


def fit(rows: DataFrame, labelled: DataFrame | None = None, templates: list[str] | None = None) -> Model:
    """The model of a log (prompt, response) and of rows that name their language (text, lang): with the given
    templates, else with all that the log has."""
    if templates is None:
        templates = [r.reply for r in _recurring(rows).orderBy(F.desc("n"), "reply").collect()]
    return Model([t.split() for t in templates], _ends(rows), language.fit(labelled) if labelled is not None else language.Languages())


def _shingles(texts: DataFrame) -> DataFrame:
    """One row per text (id, words) and distinct run of three of its words, as a number (id, g)."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            own = [{" ".join(s) for s in zip(t, t[1:], t[2:])} for t in (x.split() for x in b.column(1).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(own)), np.array([len(x) for x in own], np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([s for x in own for s in x], pa.string())], names=["id", "s"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, s string").select("id", F.xxhash64("s").alias("g"))


def _containing(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """Those of the distinct texts (words) that contain one of the templates (reply).

    A text with a template has so many of its shingles that it lacks none or few; of the template's rarest shingles, one
    more than that, it has at least one. These meet in a join; what meets is compared in full, so that shingles or
    texts of the same number do no harm.
    """
    grams = _shingles(templates.select(F.col("reply").alias("id"), F.col("reply").alias("words")))
    own = grams.join(grams.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("k"))
    enough = F.ceil(0.8 * (F.size(F.split("id", " ")) - 2)).cast("int")
    keys = own.select(F.col("id").alias("reply"), F.explode(F.slice("k", F.lit(1), F.greatest(F.size("k") - enough + 1, F.lit(0)))["g"]).alias("g"))
    texts = texts.withColumn("id", F.xxhash64("words"))
    met = _shingles(texts.select("id", "words")).join(keys, "g").groupBy("id").agg(F.collect_set("reply").alias("replies"))

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for text, replies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.split()
                there = set(zip(words, words[1:], words[2:]))
                if any(holds(words, t, len(there & set(zip(t, t[1:], t[2:])))) for t in map(str.split, replies)):
                    out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["words"])

    return texts.join(met, "id").select("words", "replies").mapInArrow(run, "words string")


def defects(log: DataFrame, labelled: DataFrame | None = None, key: str = "log_id", prompt: str = "subquestion", response: str = "response") -> DataFrame:
    """One row per defective pair: the key and ``defect``, one of ``empty``, ``refusal``, ``copy``, ``truncated`` and
    ``wrong_language``, the first that holds in this order (a reply without any marker that is no refusal counts as
    truncated). labelled (text, lang) are rows that name their language; without them no reply is in a wrong one.

    A null response, one without letters and digits, and an empty payload are ``empty``; with a null or empty prompt
    a reply can't be a copy or in the wrong language. Whole texts are read. Rows with a null key are left out,
    repeated rows give one row. Columns other than the three are left aside. An empty table gives an empty one.
    """
    rows = log.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("log_id"), F.col(prompt).alias("prompt"), F.col(response).alias("response"))
    texts = rows.select("prompt", "response")
    again = _recurring(texts)
    first = again.orderBy(F.desc("n"), "reply").limit(TEMPLATES + 1).collect()
    held = log.sparkSession.sparkContext.broadcast(fit(texts, labelled, [r.reply for r in first[:TEMPLATES]]))
    more = len(first) > TEMPLATES

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            found = [defect(p, r, held.value) for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            words = [refusable(r) if more and d not in DEFECTS[:2] else [] for d, r in zip(found, b.column(2).to_pylist())]
            # What has too few words for a template is settled.
            left = [" ".join(w) if len(w) >= SHORT else None for w in words]
            keep = pa.array([k for k, d in enumerate(found) if d or left[k]], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array(found, pa.string()).take(keep), pa.array(left, pa.string()).take(keep)], names=["log_id", "defect", "words"])

    out = rows.mapInArrow(run, "log_id long, defect string, words string")
    if not more:
        return out.select("log_id", "defect").distinct()
    out, last = written(out, "replies"), first[TEMPLATES]
    rarer = written(again.where((F.col("n") < last.n) | (F.col("n") == last.n) & (F.col("reply") >= last.reply)).select("reply"), "templates")
    refused = _containing(out.select("words").where("words is not null").distinct(), rarer).withColumn("refused", F.lit(True))
    asked = out.where("words is not null").join(refused, "words", "left").withColumn("defect", F.when(F.col("refused"), "refusal").otherwise(F.col("defect")))
    return out.where("words is null").unionByName(asked.drop("refused")).where("defect is not null").select("log_id", "defect").distinct()


def project_labels(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """text and lang of the project's questions and documents."""
    return queries.select(F.col("question").alias("text"), "lang").unionByName(documents.select("text", "lang"))
