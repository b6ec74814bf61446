"""Text quality statistics of each document, and which texts are no prose.

Statistics: words, mean word length, symbol share, share of lines that end in
punctuation, share of common words; the share of characters in running sentences;
and of repetition: shares of characters in duplicate lines, paragraphs and
sentences, coverage of the dominant n-grams. A document is no prose by the first
of these rules that holds, which ``rule`` names:

* ``blank``: nothing but blanks;
* ``structure``: less than ``PROSE_SHARE`` of its characters lie in running
  sentences, repeats included (lists, tables, logs, code, junk);
* ``repeated sentences``, ``repeated lines``, ``repeated paragraphs``: what runs
  falls under that share once each repeat is taken out;
* ``repeated words``: from ``REPEAT_WORDS`` words on the dominant 4-gram covers
  ``REPEAT_SHARE`` of the words' characters, or the dominant 2- or 3-gram more than
  half, so the text says one thing over and over without a mark between;
* ``unlike a language``: its symbols outnumber ``MOST_SYMBOLS`` of its characters,
  its words are longer or shorter than any language's, or less than ``LEAST_COMMON`` of them are common ones.

What runs is found line by line, in context: a line that is laid out as a table row, a log
entry, a path, a listing, a key with its value or an item without a sentence
is structure, and the lines between are joined again and cut into sentences,
so that hard-wrapped text is read whole. A sentence counts if it is readable
(few symbols, words that aren't broken by them) and runs (function words of
one of four languages come often enough).

Each row is one document: the work is per row, nothing is shuffled. Cases:
null and blank texts have zero words, null means and shares of zero, and are no
prose; ids are kept as they come, repeated rows stay; extra columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import spread

PROSE_SHARE = 0.5
#: From so many words on, a text whose dominant 4-gram covers so much of it only repeats.
REPEAT_WORDS, REPEAT_SHARE, REPEAT_PAIR = 40, 0.35, 0.5
MOST_SYMBOLS, WORD_LENGTHS, LEAST_COMMON = 0.4, (2.0, 12.0), 0.1
MIN_COMMON = 0.14
MAX_SYMBOLS = 0.12

#: Frequent function words of English, German, French and Spanish.
COMMON = {
    "en": "a about after again all also an and any are as at be because been before but by can could did do does each even ever everything far few for from good had has have her him his how i if in into is it its just last later least left like long made make many more most much must my no not nothing now of off on one only or other our out over own same she should since so some still such than that the their them then there these they this those through time to too twice under until up us very want was way we well were what when where whether which while who whole why will with without would yet you your",
    "de": "aber alle alles als also am an andere auch auf aus bei beide beim bereits bis da damit dann das dass dem den denn der des die dies diese dieser doch dort du durch ein eine einem einen einer eines er erst es etwa für haben hat hatte ich ihr im immer in ist ja jede jeder jetzt kann kein keine können man mehr mit muss müssen nach nicht nichts noch nun nur ob oder offen ohne schon sehr sein seit sich sie sind so sondern steht über um und uns unter vom von vor waren warum was weil wenn werden wieder wie wir wird wo wurde wurden zu zum zur zweite deshalb anders früher dafür",
    "fr": "a ai alors au aucun aussi autre aux avant avec avoir avons bien car ce cela ces cet cette chaque comme dans de depuis des deux dont du elle elles en encore entre est et eu faire fait faut il ils je jour la le les leur leurs lorsque lui mais même moins ne ni non nos notre nous on ont ou où par parce pas pendant peu peut plus pour pourquoi qu quand que quelle quels qui s sa sans se ses si sont sous sur tout toute toutes tous très trop un une vers vous y été étaient était l d n c j m t",
    "es": "a al algo ante antes aún aunque bajo bien cada como con cuando de del desde después donde dos el él ella ellas ellos en entre era eran es esa ese eso esta está están estas este esto estos fue fueron ha habían había hacia han hasta hay hemos la las le les lo los más me mientras muy nada ni no nos nosotros nuestro o otra otro otros para pero poco por porque pues que qué quien se según ser si sí siempre sin sobre solo son su sus también tan tanto te tiene todavía toda todas todo todos tras tu un una unas unos van ya y yo",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
#: For each word the languages it is common in, as a number in base 4096 with a place per language.
_PLACES = {w: sum((w in words) << (12 * k) for k, words in enumerate(_COMMON.values())) for w in frozenset().union(*_COMMON.values())}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_CODE = re.compile(r"`[^`\n]*`|\b[^\W_]*+_\w+(?:\(\))?|\b[\w\-]++(?:/[\w\-.]+)+|https?://\S+|\b\w++\(\)")
_ODD = re.compile(r"[^\w\s.,;:!?'’\"“”„«»()¿¡\-–—…%&/]")
_SYMBOL = re.compile(r"[^\w\s]")
_ASCII_NO_SYMBOL = {c: None for c in range(128) if chr(c).isalnum() or chr(c).isspace()}
_BROKEN = re.compile(r"[^\W\d_](?:[^\w\s'’\-./,)(\"“”»«][^\W\d_]|\d)|\d[^\W\d_]")
#: What any odd or broken place holds.
_SUSPECT = re.compile(r"[^\w\s.,'’\"“”«»()¿¡\-–—…/;:!?%&]|[;:!?%&“”«»¿¡–—…][^\W\d_]|[^\W\d_]\d|\d[^\W\d_]")
_UNPLAIN = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ \n.,'’\"()\-/]")
_END = re.compile(r"""[.!?…]["'”»)\]]*\s+""")
_STRUCTURE = re.compile(
    r"""(?x)^\s*(?:
      \|.*\|?\s*$ | [+|][-=+|\s]{3,}$ | [-=_~\#.*^+]{3,}\s*$        # rules and frames of tables
      | [^\t]*\t[^\t]*\t.* | \S.*\S\s{3,}\S.*                       # columns
      | [0-9a-fA-F]{6,8}\s+(?:[0-9a-fA-F]{2}\s+){4,}.*              # dumps
      | \d{4}-\d\d-\d\d[T\ ]\d\d:\d\d.* | \[?\d\d:\d\d(?::\d\d)?\]?\s.*(?:INFO|WARN|ERROR|DEBUG).* | (?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b.*
      | File\ ".*",\ line\ \d+.* | Traceback\b.* | at\ [\w.$<>]+\(.*\) # traces
      | [\w.\-]+(?:/[\w.\-]+)+/?\s*$ | [\w.\-\[\]]+\s*(?:==|>=|<=|~=)\s*[\w.*]+\s*$ # paths, pins
      | [\-*•·]?\s*\[[\ xX]\]\s.* | [•·]\s*\#\d+.*
      | [\-*+]\s+\*\*.*?\*\*\s*[:\-].{0,60}$
      | "?[\w\-.]+"?\s*[:=]\s*[\w\-./"']*(?:\s+[\w\-./]+)?\s*[,;]?\s*$ # keys with short values
      | [{}\[\]();,<>]+\s*$ | </?\w[^>]*>\s*$
      | (?:[^,;\s]+,){2,}[^,;\s]*\s*$ | (?:[^\s,]+,\s){1,6}[^\s,]+;\s*$ | (?:"[^"]*"|[^,]{0,24})(?:,(?:"[^"]*"|[^,\ ]{0,24})){2,}\s*$
      )"""
)
_ITEM = re.compile(r"^\s*(?:[\-*+•·>]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
_HEAD = re.compile(r"^\s*(?:\#{1,6}|=+)\s+\S")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_SPEAKER = re.compile(r"^\s*[\w.\-]{1,24}:\s+(?=\S)")


#: Two- and three-byte characters read as single bytes; a reader still sees the word.
_MOJIBAKE = re.compile(r"[ÃÂãâ][\x80-\xbf\u0152-\u0178\u02c6\u02dc\u2013-\u203a\u20ac\u2122]|â€.")


def _bare(part: str) -> str:
    """Without what is marked as code, which is read as one word."""
    if not part.isascii() and ("â" in part or "Ã" in part or "Â" in part or "ã" in part):
        part = _MOJIBAKE.sub("e", part)
    return _CODE.sub(" x ", part) if "_" in part or "/" in part or "`" in part or "()" in part else part


def readable(bare: str) -> bool:
    """Few symbols, and words that aren't broken by digits or symbols."""
    if not _UNPLAIN.search(bare) or not _SUSPECT.search(bare):
        return bool(bare.strip())
    tokens = bare.split()
    dense = sum(map(len, tokens))
    return bool(dense) and len(_ODD.findall(bare)) <= MAX_SYMBOLS * dense and len(_BROKEN.findall(bare)) <= 0.15 * len(tokens)


_EDGES = ".,;:!?…\"'“”„«»()¿¡-–—"


_ZEROS = (0,) * 4000


def _common(words: list[str]) -> int:
    """How many are common in the language that has most of them; at least, where those are enough to run."""
    get, total = _PLACES.get, 0
    if len(words) <= 4000:  # as most words have no mark at their edges, they alone often are enough
        total = sum(map(get, words, _ZEROS))
        best = max(total & 4095, (total >> 12) & 4095, (total >> 24) & 4095, total >> 36)
        if best >= 2 and best >= MIN_COMMON * len(words):
            return best
    total = 0
    for w in words:
        n = get(w)
        if n is None and not w.isalpha():
            w = w.strip(_EDGES)
            n = get(w)
            if n is None and ("'" in w or "’" in w):
                n = get(w.replace("’", "'").split("'")[0])
        if n:
            total += n
    # a place of 4096 holds any sentence; longer stretches are counted language by language
    if len(words) > 4000:
        clean = [w.strip(_EDGES).replace("’", "'").split("'")[0] for w in words]
        return max(sum(w in c for w in clean) for c in _COMMON.values())
    return max(total & 4095, (total >> 12) & 4095, (total >> 24) & 4095, total >> 36)


def runs(bare: str) -> bool:
    """Function words of one language come often enough, as in sentences."""
    words = bare.lower().split()
    if len(words) < 3:
        return False
    best = _common(words)
    return best >= 2 and best >= MIN_COMMON * len(words)


def _plainly_text(s: str) -> bool:
    """A line of many words without any mark of structure."""
    blanks = s.count(" ")
    return blanks >= 6 and s[0].isalpha() and "\t" not in s and "   " not in s and "|" not in s and s.count(",") * 3 < blanks and not s.startswith(("File ", "at ", "Traceback", "INFO", "WARN", "ERROR", "DEBUG", "TRACE"))


_TO_BLANK = {c: " " for c in range(128) if not chr(c).isalpha()}


def words_of(low: str) -> list[str]:
    """Runs of letters, apostrophes inside; plain texts are cut without the pattern."""
    return low.translate(_TO_BLANK).split() if low.isascii() and "'" not in low else _WORD.findall(low)


def sentences(text: str | list[str]) -> list[str]:
    """Stretches between structure, wrapped lines joined, cut at sentence ends."""
    out, part = [], []

    def close():
        if part:
            whole, at = " ".join(part), 0
            for m in _END.finditer(whole):
                out.append(whole[at : m.start() + 1])
                at = m.end()
            if at < len(whole):
                out.append(whole[at:])
            part.clear()

    for line in text.splitlines() if isinstance(text, str) else text:
        s = line.strip()
        if not s or _HEAD.match(line):
            close()
            continue
        plain = _plainly_text(s)
        item = _ITEM.match(line) if not plain or s[1] in ".)" else None
        if not plain and _STRUCTURE.match(line) and not (s[-1] in ".!?" and len(_WORD.findall(s)) >= 8 and runs(_bare(s))):
            # a wrapped line of few words may look like a key or a list; it is one if it stands alone
            close()
            continue
        speaker = _SPEAKER.match(s)
        if item or speaker:
            close()
            s = s[(item.end() - (len(line) - len(line.lstrip()))) if item else speaker.end() :]
        if s:
            part.append(s)
    close()
    return out


def prose_chars(text: str | list[str]) -> tuple[int, int]:
    """Characters of readable running sentences, and those of them that stood before."""
    seen, n, again = set(), 0, 0
    for s in sentences(text):
        low = s.lower()
        key = " ".join(low.split())
        if key in seen:
            n += len(s) + 1
            again += len(s) + 1
            continue
        bare = _bare(low)
        if runs(bare) and readable(bare):
            seen.add(key)
            n += len(s) + 1
    return n, again


def prose_weight(text: str | None) -> float:
    """The share of a text that is running sentences, each counted once."""
    running, again = prose_chars(text or "")
    return min(1.0, _share(running - again, len((text or "").strip())))


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def duplicate_share(parts: list[str]) -> float:
    """Characters in parts that stood before, of all characters."""
    once = dict.fromkeys(parts)
    if len(once) == len(parts):
        return 0.0
    total = sum(map(len, parts))
    return _share(total - sum(map(len, once)), total)


def dominant_ngrams(texts: list[list[str]], sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """For each text and n the characters covered by the most frequent n-gram that repeats, of all in words.

    All texts of a batch are counted together. Overlapping hits cover a word
    once; among equally frequent n-grams the first counts.
    """
    out = np.zeros((len(texts), len(sizes)))
    counts = np.array([len(t) for t in texts])
    flat = [w for t in texts for w in t]
    if not flat:
        return out
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.array(list(map(index.__getitem__, flat)), np.int64)
    lengths = np.array(list(map(len, flat)), np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    total = np.bincount(doc, lengths, len(texts))
    code, width, base = pd.factorize(doc * len(index) + ids)[0], 1, len(index)
    for at, n in enumerate(sizes):
        while width < n and len(code) > 1:  # number the n-grams by those of n - 1 words
            code = pd.factorize(code[:-1] * base + ids[width:])[0]
            width += 1
        if width < n:
            break
        here = doc[: len(code)]
        inside = here == doc[width - 1 :]  # both ends lie in one text
        times = np.bincount(code, inside)[code].astype(np.int64)
        times[~inside] = 0
        starts = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        most = np.zeros(len(texts), np.int64)
        most[here[starts]] = np.maximum.reduceat(times, starts)
        top = np.flatnonzero((times == most[here]) & (times > 1))
        first = top[np.r_[True, here[top][1:] != here[top][:-1]]] if len(top) else top
        best = np.full(len(texts), -1)
        best[here[first]] = code[first]
        found = (code == best[here]) & inside
        hit = np.zeros(len(flat), bool)
        for k in range(n):
            hit[k : k + len(code)] |= found
        out[:, at] = np.divide(np.bincount(doc, lengths * hit, len(texts)), total, out=np.zeros(len(texts)), where=total > 0)
    return out


FIELDS = [
    ("n_chars", "bigint"), ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_share", "double"), ("ended_line_share", "double"),
    ("common_word_share", "double"), ("duplicate_line_share", "double"), ("duplicate_paragraph_share", "double"), ("running_share", "double"), ("repeated_sentence_share", "double"),
    ("top_2gram_share", "double"), ("top_3gram_share", "double"), ("top_4gram_share", "double"), ("rule", "string"), ("is_prose", "boolean"),
]
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
SCHEMA = "doc_id bigint, " + ", ".join(f"{k} {t}" for k, t in FIELDS)


def _measured(text: str | None) -> tuple[tuple, list[str]]:
    text = text or ""
    size = len(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    words = words_of(text.lower())
    chars = sum(map(len, words))
    raw = text.splitlines()
    lines = [x for x in map(str.strip, raw) if x]
    paragraphs = [x for x in map(str.strip, _PARAGRAPH.split(text)) if x]
    solid = len("".join(text.split()))
    symbols = len(text.translate(_ASCII_NO_SYMBOL)) if text.isascii() else len(_SYMBOL.findall(text)) + text.count("_")
    running, again = prose_chars(raw)
    whole = len(text.strip())
    return (
        size, len(words), chars / len(words) if words else None, _share(symbols, solid),
        _share(sum(x[-1] in ".!?…:;\"'”»)" for x in lines), len(lines)), _share(sum(map(_PLACES.__contains__, words)), len(words)),
        duplicate_share(lines), duplicate_share(paragraphs), min(1.0, _share(running, whole)), min(1.0, _share(again, whole)),
    ), words


def rule_of(n_words: int, word_length: float | None, symbols: float, common: float, lines: float, paragraphs: float, running: float, repeated: float, grams: tuple[float, float, float]) -> str | None:
    """The first rule by which a document with these statistics is no prose."""
    if word_length is None and not running:
        return "blank" if not symbols else "structure"
    if running < PROSE_SHARE:
        return "structure"
    for what, share in (("sentences", repeated), ("lines", lines), ("paragraphs", paragraphs)):
        if running - share < PROSE_SHARE:
            return f"repeated {what}"
    if n_words >= REPEAT_WORDS and (grams[2] >= REPEAT_SHARE or max(grams[:2]) >= REPEAT_PAIR):
        return "repeated words"
    if symbols > MOST_SYMBOLS or common < LEAST_COMMON or not WORD_LENGTHS[0] <= (word_length or 0) <= WORD_LENGTHS[1]:
        return "unlike a language"
    return None


def statistics(texts: list[str | None]) -> list[tuple]:
    """The fields of each text."""
    parts = [_measured(t) for t in texts]
    grams = dominant_ngrams([w for _, w in parts])
    out = []
    for (row, _), g in zip(parts, grams):
        g = tuple(map(float, g))
        rule = rule_of(row[1], row[2], row[3], row[5], row[6], row[7], row[8], row[9], g)
        out.append((*row, *g, rule, rule is None))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            columns = zip(*statistics(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, FIELDS))], names=["doc_id", *(k for k, _ in FIELDS)])


def text_quality(documents: DataFrame) -> DataFrame:
    """Statistics of every row of ``doc_id, text``."""
    return spread(pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(_rows, SCHEMA)


def no_prose(documents: DataFrame) -> DataFrame:
    return text_quality(documents).where(~F.col("is_prose")).select("doc_id")
