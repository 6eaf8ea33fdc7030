"""Noise in text from scanned pages: running heads, page numbers, words broken over lines, misread characters.

Lines that only repeat a name of their PDF are found by an equi-join on (PDF, letters of the line), page numbers by
their form and page. A word broken over a line end is joined unless the corpus writes it with a hyphen. Misread words
are found by a noisy channel: every distinct word gives the words it may stand for under a table of confusions, an
equi-join with the corpus's word counts keeps the plausible ones, and Viterbi decoding over the candidate words, with
bigram counts of the whole corpus as likelihood, picks the reading. How probable each confusion is, is estimated from
the corpus: from the words that one reading outweighs by far.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: What is written, what the scan shows, and how often to begin with, as a share of such characters.
CONFUSIONS = (
    ("e", "ø", 0.02), ("e", "c", 0.02), ("a", "ɑ", 0.02), ("o", "0", 0.02), ("t", "f", 0.02), ("i", "l", 0.02), ("i", "1", 0.02),
    ("s", "5", 0.02), ("n", "u", 0.02), ("d", "cl", 0.02), ("l", "1", 0.02), ("u", "ii", 0.02), ("h", "b", 0.02), ("m", "rn", 0.02),
    ("b", "6", 0.01), ("w", "vv", 0.02), ("g", "9", 0.02), ("z", "2", 0.01), ("ri", "n", 0.005), ("nn", "rm", 0.01), ("li", "h", 0.01), ("rn", "m", 0.02),
)
CHAPTER = "chapter|part|section|chapitre|partie|kapitel|teil|abschnitt|capítulo|capitulo|parte|sección"
#: Characters and runs that no word of the corpus's languages is written with.
ODD = re.compile(r"ɑ|ø|ii|vv|(?<=[^\W\d]{2})[012569](?=[^\W\d])|(?<=[^\W\d])[012569](?=[^\W\d]{2})|^[12569](?=[^\W\d]{4})|(?<=[^\W\d]{4})[012569]$")
MARKS = "-­‐‑¬–"
BREAK = "\r\n|\n|\r"
_LINE = re.compile(BREAK)
_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)+")
_TAIL = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{MARKS}])[ \t]*$")
_HEAD = re.compile(r"[ \t]*([^\W\d_][^\W_]*(?:-[^\W_]+)*)")
_PAGE = re.compile(r"\s*(?:(?:page|seite|página|pagina|pág\.|p\.|s\.)\s*(\d{1,5})(?:\s*(?:of|von|de|sur|/)\s*\d{1,5})?|(\d{1,5})\s*(?:/|of|von|de|sur)\s*\d{1,5}|[-–—·|\[(]\s*(\d{1,5})\s*[-–—·|\])]|(\d{1,5})|([ivxlcdm]{1,9}))\s*", re.I)
_CHAPTER = re.compile(rf"[\W\d_]*(?:{CHAPTER})\s+(?:\d+|[ivxlc]+)\s*[:.–—-]\s*\S.*", re.I)
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S ){4,}\S")
_PARTS = re.compile(r"[·|•]")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Smoothing of the word model, and weight of the unigram in the bigram model.
ALPHA, KAPPA = 0.05, 20.0
#: Occurrences that the confusions' first probabilities count for, and how often a reading must outweigh a word to
#: count in their estimate.
PRIOR, OUTWEIGHS = 20_000, 50
#: What the context may add to a reading, as a factor; log odds against a word that no language spells so, however
#: often the scans repeat it.
ROOM, ODDS = 20, 5.0


def roman(s: str) -> int:
    """The value of a Roman number."""
    n = [_ROMAN[c] for c in s.lower()]
    return sum(-a if k + 1 < len(n) and a < n[k + 1] else a for k, a in enumerate(n))


def is_page_number(line: str, page: int | None) -> bool:
    """Whether a line is only a page number. Without any ornament the number must be near the page's own."""
    m = _PAGE.fullmatch(line)
    if not m:
        return False
    if m[5] or m[4]:
        n = roman(m[5]) if m[5] else int(m[4])
        return page is not None and abs(n - page) <= 2
    return True


def is_chapter(line: str) -> bool:
    """Whether a line, or a part of it between ornaments, is the name of a numbered chapter. Letters may be spaced out."""
    line = line.strip()
    if line.endswith((".", "!", "?")):
        return False
    if _SPACED.search(line):
        line = re.sub(r"(?<=\S) (?=\S)", "", line)
    return any(_CHAPTER.fullmatch(part.strip(" \t—–-")) for part in _PARTS.split(line))


def letters(text: Column) -> Column:
    """The letters of a line, lower-cased: what two lines that name the same thing have in common."""
    return F.regexp_replace(F.lower(text), "[^\\p{L}]+", "")


def items_of(content: DataFrame) -> DataFrame:
    """item_id, field, pdf_id, page, target and text of every text or content of every item, once. target: it is of
    type text, list or other and no heading."""
    target = F.col("item_type").isin("text", "list", "other") & (F.coalesce("text_level", F.lit(0)) <= 0)
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("text", "content")])).alias("x")
    rows = content.where("item_id is not null").select("item_id", "pdf_id", F.col("page_idx").alias("page"), F.coalesce(target, F.lit(False)).alias("target"), fields)
    return rows.select("item_id", "x.field", "pdf_id", "page", "target", "x.text").where("text is not null").dropDuplicates(["item_id", "field"])


def running_heads(items: DataFrame, content: DataFrame) -> DataFrame:
    """item_id, field and the numbers (from 0) of the lines that only repeat a name of their PDF: its title, a heading
    or the text of a header. A name's letters decide; numbers, case and ornaments don't."""
    named = F.when((F.col("item_type") == "header") | (F.col("text_level") > 0), F.col("text"))
    names = content.select("pdf_id", F.explode(F.array("title", named)).alias("name")).select("pdf_id", letters(F.col("name")).alias("key")).where("length(key) >= 4").distinct()
    lines = items.where("target").select("item_id", "field", "pdf_id", F.posexplode(F.split("text", BREAK)).alias("line", "s"))
    parts = F.array_union(F.array("s"), F.split("s", "[·|•]"))  # the whole line, or a part of it between ornaments
    keyed = lines.select("item_id", "field", "pdf_id", "line", F.explode(parts).alias("s")).select("item_id", "field", "pdf_id", "line", letters(F.col("s")).alias("key")).where("length(key) >= 4")
    return keyed.join(names, ["pdf_id", "key"]).groupBy("item_id", "field").agg(F.collect_set("line").alias("heads"))


def parse(text: str, heads: set[int], page: int | None, noisy: bool = True):  # noqa: ANN201
    """Lines that stay, with defects of lines that don't, the words in order with words broken over lines joined, the
    compounds and the breaks: (line among those that stay, joined word, compound, mark)."""
    kept, defects = [], set()
    for k, line in enumerate(_LINE.split(text)):
        if noisy and (k in heads or is_chapter(line)):
            defects.add("running_head")
        elif noisy and is_page_number(line, page):
            defects.add("page_number")
        else:
            kept.append(line)
    filled = [k for k, line in enumerate(kept) if line.strip()]
    words, compounds, breaks = [], [], []
    carry = ""
    for n, k in enumerate(filled):
        line = carry + kept[k].lstrip() if carry else kept[k]
        carry = ""
        tail = _TAIL.search(line)
        follow = _HEAD.match(kept[filled[n + 1]]) if tail and n + 1 < len(filled) else None
        compounds += [c.lower() for c in _COMPOUND.findall(line)]
        if follow and follow[1][0].islower() or follow and tail[2] != "-" and follow:
            breaks.append((k, (tail[1] + follow[1]).lower(), (tail[1] + "-" + follow[1]).lower(), tail[2]))
            line, carry = line[: tail.start()], line[tail.start() : tail.end(1)]
        words += _WORD.findall(line.lower())
    words += _WORD.findall(carry.lower())
    return kept, defects, words, compounds, breaks


_PARSED = "item_id long, field string, page int, target boolean, heads array<int>, text string, words array<string>, compounds array<string>, breaks array<struct<joined:string,compound:string>>"
_BY_SEEN: dict[str, list[tuple[str, int]]] = {}
for _k, (_true, _seen, _p) in enumerate(CONFUSIONS):
    _BY_SEEN.setdefault(_seen, []).append((_true, _k))
_FIRST = tuple(math.log(p) for _, _, p in CONFUSIONS)


def readings(word: str, least: float, logs: tuple[float, ...] = _FIRST) -> dict[str, tuple[float, tuple[int, ...]]]:
    """The words a scanned word may stand for, with the log probability of the channel, of at least `least`, and the
    confusions that lead there. Any number of confusions: after the first, those at the first odd place, while there
    is one."""
    out: dict[str, tuple[float, tuple[int, ...]]] = {}
    todo = [(word, 0.0, ())]
    while todo:
        fresh = []
        for w, lp, how in todo:
            odd = ODD.search(w) if how else None
            if how and not odd:
                continue
            for seen, trues in _BY_SEEN.items():
                at = w.find(seen)
                while at >= 0:
                    if not odd or at < odd.end() and at + len(seen) > odd.start():
                        for true, k in trues:
                            c, q = w[:at] + true + w[at + len(seen) :], lp + logs[k]
                            if c != word and q >= least and (c not in out or q > out[c][0]):
                                out[c] = (q, (*how, k))
                                fresh.append((c, q, (*how, k)))
                    at = w.find(seen, at + 1)
        todo = fresh
    return out


def _read_vocabulary(least: float):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(w, n, c, list(how), ODDS if ODD.search(w) else 0.0) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(w) > 1 and not w.isdigit() for c, (_, how) in readings(w, least).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.float64()))], names=["w", "n", "cand", "how", "odds"])

    return run


def channel(good: DataFrame, vocabulary: DataFrame) -> list[float]:
    """The log probability of each confusion, from good (w, n, cand, how, cn), words that may be misread: how often it
    explains a word that its likeliest reading outweighs by OUTWEIGHS, of how often its characters are written. That
    compares the confusions with one another over the whole corpus; their level is the first values', which is that of
    a scanned page. The first values also count for PRIOR occurrences. A row per confusion comes to the driver."""
    best = good.groupBy("w").agg(F.max_by(F.struct("n", "how", "cn"), "cn").alias("x")).where(F.col("x.cn") >= OUTWEIGHS * F.col("x.n"))
    seen = dict(best.select("x.n", F.explode("x.how").alias("k")).groupBy("k").agg(F.sum("n")).collect())
    as_written = vocabulary.agg(*[F.sum(F.col("n") * ((F.length("w") - F.length(F.replace("w", F.lit(t), F.lit("")))) / len(t))) for t, _, _ in CONFUSIONS]).first()
    count = [float(x or 0) for x in as_written]
    first = [p for _, _, p in CONFUSIONS]
    level = sum(p * n for p, n in zip(first, count)) / max(sum(seen.values()), 1)
    return [math.log((seen.get(k, 0) * level + p * PRIOR) / (n + PRIOR)) for k, (p, n) in enumerate(zip(first, count))]


def decode(observed: list[str], options: list[list[tuple[str, float, int]]], left: str | None, right: str | None, pairs: dict[tuple[str, str], int], total: int) -> list[str]:
    """Viterbi: the likeliest words of a run of suspicious ones. options has for each of them (word, channel's log
    probability, count without this occurrence), the word itself included; left and right are the words around."""

    def step(a: str | None, b: str, n: int, own: bool) -> float:
        base = (n + ALPHA) / total
        return math.log(max(0, pairs.get((a, b), 0) - own if a is not None else 0) + KAPPA * base)

    best = {w: (step(left, w, n, w == observed[0]) + lp, [w]) for w, lp, n in options[0]}
    for k in range(1, len(options)):
        fresh = {}
        for w, lp, n in options[k]:
            fresh[w] = max(((s + step(a, w, n, w == observed[k] and a == observed[k - 1]) + lp, path + [w]) for a, (s, path) in best.items()), key=lambda x: x[0])
        best = fresh
    if right is not None:
        # The word after it speaks for a reading only as far as that pair is known; each word's own rate divides out.
        counts = {w: n for w, _, n in options[-1]}
        best = {w: (s + math.log((max(0, pairs.get((w, right), 0) - (w == observed[-1])) + 0.1) / (counts[w] + 1.0)), p) for w, (s, p) in best.items()}
    return max(best.values(), key=lambda x: x[0])[1]


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def mend(text: str, heads: set[int], page: int | None, counts: dict[str, int], options: dict[int, list[tuple[str, float, int]]], pairs: dict[tuple[str, str], int], total: int) -> tuple[str, list[str]]:
    """The repaired text and its defects. counts has the corpus's counts of joined words and compounds; options the
    candidates by position among the words."""
    kept, defects, words, _, breaks = parse(text, heads, page)
    fixed: dict[int, str] = {}
    at = sorted(options)
    while at:
        run = [at.pop(0)]
        while at and at[0] == run[-1] + 1:
            run.append(at.pop(0))
        opts = [options[k] for k in run]
        got = decode([words[k] for k in run], opts, words[run[0] - 1] if run[0] else None, words[run[-1] + 1] if run[-1] + 1 < len(words) else None, pairs, total)
        fixed |= {k: w for k, w in zip(run, got) if w != words[k]}
    joins = {k: mark != "-" or counts.get(compound, 0) <= counts.get(joined, 0) for k, joined, compound, mark in breaks}
    if any(joins.values()):
        defects.add("hyphen")
    if fixed:
        defects.add("misread")
    # Rebuild: paragraphs are runs of filled lines; words are counted as parse() counts them.
    out, paragraph, carry, last, n = [], [], "", None, 0
    for k, line in enumerate(kept):
        if not line.strip():
            follow = next((x for x in kept[k + 1 :] if x.strip()), "").lstrip()
            if not carry and paragraph and (paragraph[-1].rstrip().endswith((".", "!", "?", ":", "”", '"')) or not follow[:1].islower()):
                out.append(" ".join(paragraph))
                paragraph = []
            continue
        line = line.strip()
        if carry:
            line, carry = carry + line, ""
        if k in joins:
            m = _TAIL.search(line)
            carry = line[m.start() : m.end(1)] + ("" if joins[k] else "-")
            line = line[: m.start()].rstrip()
        if line:
            paragraph.append(line)
    if carry:
        paragraph.append(carry)
    if paragraph:
        out.append(" ".join(paragraph))
    whole = "\n\n".join(out)
    if fixed:
        joined_real = {k for k, good in joins.items() if not good}
        compound_at: list[tuple[int, int]] = []
        n, pieces, end = 0, [], 0
        # A real compound is two words here but one in parse(): step over its second half.
        glued = {j: c.replace("‐", "-") for k, j, c, _ in breaks if k in joined_real}
        spans = list(_WORD.finditer(whole))
        k = 0
        while k < len(spans):
            m = spans[k]
            if n < len(words) and m[0].lower() != words[n] and words[n] in glued:
                j = k
                seen = ""
                while j < len(spans) and len(seen) < len(words[n].replace("-", "")):
                    seen += spans[j][0].lower()
                    j += 1
                k = j
                n += 1
                continue
            if n in fixed and m[0].lower() == words[n]:
                pieces += [whole[end : m.start()], _cased(fixed[n], m[0])]
                end = m.end()
            n += 1
            k += 1
        whole = "".join(pieces) + whole[end:]
    return whole, sorted(defects)


def repair(content: DataFrame) -> DataFrame:
    """item_id, field, text (repaired) and defects of every text and content of items of type text, list or other that
    are no headings; content has the columns of content_item, others are left aside.

    Clean texts come out as continuous paragraphs without defects; empty and blank texts come out empty, null ones not
    at all, and rows with a null item_id are left out. Repeated rows count once, in the counts of words too. A line is
    a running head if its letters are those of the PDF's title, a heading or a header; line breaks alone are no
    defect. Word and bigram counts cover the whole corpus and are joined, not broadcast.
    """
    items = items_of(content)
    heads = running_heads(items, content)
    ready = items.join(heads, ["item_id", "field"], "left").select("item_id", "field", "page", "target", F.coalesce("heads", F.array().cast("array<int>")).alias("heads"), "text")

    def read(batches):  # noqa: ANN001, ANN202
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            got = [parse(t, set(h), p, g) for p, g, h, t in zip(c[2], c[3], c[4], c[5])]
            extra = [pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.string())), pa.array([[{"joined": j, "compound": m} for _, j, m, _ in g[4]] for g in got], pa.list_(pa.struct([("joined", pa.string()), ("compound", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "words", "compounds", "breaks"])

    parsed = written(ready.mapInArrow(read, _PARSED), "parsed")
    vocabulary = written(parsed.select(F.explode(F.concat("words", "compounds")).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "vocabulary")
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    # What each distinct word may stand for: candidates that outweigh it, with room for what the context may say. A
    # channel below `least` could not be outweighed by any count.
    least = math.log(ALPHA / ROOM / (total + ALPHA)) - ODDS
    guesses = vocabulary.mapInArrow(_read_vocabulary(least), "w string, n long, cand string, how array<int>, odds double")
    known = vocabulary.select(F.col("w").alias("cand"), F.col("n").alias("cn"))
    good = written(guesses.join(known, "cand").where("cn > n"), "readings")
    logs = F.array(*[F.lit(x) for x in channel(good, vocabulary)])
    lp = F.aggregate("how", F.col("odds"), lambda a, k: a + F.get(logs, k))
    good = good.withColumn("lp", lp).where((F.col("cn") + ALPHA) * F.exp("lp") * ROOM > F.col("n") - 1 + ALPHA)
    standing = good.groupBy("w").agg(F.first("n").alias("n"), F.collect_list(F.struct("cand", "lp", F.col("cn").alias("n"))).alias("cands"))
    # Each word with its neighbours, without the array it comes from.
    shifted = F.arrays_zip(F.col("words").alias("w"), F.concat(F.array(F.lit(None).cast("string")), "words").alias("before"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("after"))
    tokens = parsed.where("target").select("item_id", "field", F.posexplode(shifted).alias("pos", "x")).select("item_id", "field", "pos", "x.w", "x.before", "x.after").where("w is not null")
    suspicious = written(tokens.join(standing, "w").withColumn("cands", F.array_append("cands", F.struct(F.col("w").alias("cand"), F.lit(0.0).alias("lp"), (F.col("n") - 1).alias("n")))), "suspicious")
    # Bigrams that decoding may ask for: around a suspicious word, and between two of them.
    one, two = suspicious.alias("x"), suspicious.alias("y")
    names = F.col("cands.cand")
    before = suspicious.where("before is not null").select("item_id", "field", F.col("before").alias("l"), F.explode(names).alias("r"))
    after = suspicious.where("after is not null").select("item_id", "field", F.explode(names).alias("l"), F.col("after").alias("r"))
    between = one.join(two, (F.col("x.item_id") == F.col("y.item_id")) & (F.col("x.field") == F.col("y.field")) & (F.col("x.pos") + 1 == F.col("y.pos"))).select("x.item_id", "x.field", F.explode("x.cands.cand").alias("l"), F.col("y.cands.cand").alias("rs")).select("item_id", "field", "l", F.explode("rs").alias("r"))
    asked = before.unionByName(after).unionByName(between)
    follow = F.arrays_zip(F.col("words").alias("l"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("r"))
    bigrams = parsed.select(F.explode(follow).alias("p")).select("p.l", "p.r").where("r is not null").groupBy("l", "r").agg(F.count("*").alias("c"))
    # Counts of the words that breaks over lines ask for, in both spellings.
    wanted = parsed.where("target and size(breaks) > 0").select("item_id", "field", F.explode(F.array_distinct(F.concat("breaks.joined", "breaks.compound"))).alias("w"))
    # All that belongs to an item meets in one shuffle.
    kinds = {"page": "int", "heads": "array<int>", "text": "string", "pair": "struct<l:string,r:string,c:bigint>", "option": "struct<pos:int,cands:array<struct<cand:string,lp:double,n:bigint>>>", "count": "struct<w:string,n:bigint>"}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("item_id", "field", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    parts = rows(parsed.where("target"), page=F.col("page"), heads=F.col("heads"), text=F.col("text"))
    parts = parts.unionByName(rows(asked.join(bigrams, ["l", "r"]), pair=F.struct("l", "r", "c")))
    parts = parts.unionByName(rows(suspicious, option=F.struct("pos", "cands")))
    parts = parts.unionByName(rows(wanted.join(vocabulary, "w"), count=F.struct("w", "n")))
    gathered = [F.first(c, True).alias(c) for c in ("page", "heads", "text")]
    full = parts.groupBy("item_id", "field").agg(*gathered, F.collect_set("pair").alias("pairs"), F.collect_list("option").alias("options"), F.collect_list("count").alias("counts"))

    def finish(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for page, heads, text, pairs, options, counts in zip(*[b.column(k).to_pylist() for k in range(2, 8)]):
                opts = {o["pos"]: [(c["cand"], c["lp"], c["n"]) for c in o["cands"]] for o in options or []}
                out.append(mend(text, set(heads), page, {c["w"]: c["n"] for c in counts or []}, opts, {(p["l"], p["r"]): p["c"] for p in pairs or []}, total))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["item_id", "field", "text", "defects"])

    return full.mapInArrow(finish, "item_id long, field string, text string, defects array<string>")
