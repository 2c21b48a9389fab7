"""Text quality statistics per document, and what kind of text it mostly is.

Method: the characters of whole batches of documents are classified by one table, and all
statistics are counts over the classes, in Arrow batches without a loop over characters
(some thirty patterns run over each text cost eight times as much); a Gaussian mixture
is fitted to the standardised statistics by expectation-maximisation, run until it gains
no more; its components are mapped to prose, list, table or junk by inspected examples. Every
step of EM is one pass over the packed statistics of all documents that adds up moments in each
task and sums them; what returns to the driver is a few numbers per component, whatever the corpus.

The examples are a fixed set of short texts below, of which every kind has several, and the
hand labels of ``labels``, of which at most ``MAX_LABELLED`` documents (those of least id) are
used, as seeds and for the mapping; a component takes the kind with most of its examples, so
a few wrong labels do no harm. The mixture is fitted to all documents.

Results for odd inputs: null, empty and blank texts get statistics of zero and the kind
null; a text of any length is one row; a repeated document is one row per delivery; without
``labels`` the built-in examples serve alone.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspan.runtime import reliable_checkpoint

KINDS = ("prose", "list", "table", "junk")
#: Labelled documents that may seed the mixture.
MAX_LABELLED = 5_000
#: Components per kind (fewer where a kind has fewer examples), and what is added to every variance.
COMPONENTS = {"prose": 10, "list": 12, "table": 10, "junk": 16}
VARIANCE_FLOOR = 0.05
#: EM ends when a pass gains less log-likelihood a row than this; it warns if it has not after so many passes.
TOLERANCE = 1e-3
MAX_STEPS = 200
#: Documents that the seed of a component counts as: a component without any document stays where its seed is.
SEED_COUNT = 1.0
#: Standardised statistics are cut here, so that one absurd text moves no mean.
CLIP = 6.0
#: Inspected examples: short texts of which the kind is beyond doubt, written for this module from general knowledge.
EXAMPLES: dict[str, tuple[str, ...]] = {
    "prose": (
        "We walked along the river until it was dark. Nobody had told us that the bridge was closed, so we went back.",
        "The film is slow, but the last half hour is worth it. I would watch it again with friends.",
        "It rained for three days.\nOn the fourth day the road was open again, and the shop had bread.",
        "Das Haus liegt am Rand der Stadt und ist nicht leicht zu finden. Wer es sieht, vergisst es nicht.",
        "La maison est claire et le jardin donne sur la rue. Les voisins sont très gentils.",
        "La casa es grande y el barrio no tiene mucho ruido. Me gustó más de lo que esperaba.",
        "この店のパンはとてもおいしいです。また来週も行きたいと思います。",
        "honestly i did not like it at first but then it grew on me and now i play it every day",
    ),
    "list": (
        "- flour\n- two eggs\n- sugar\n- a lemon\n- butter",
        "Needed:\n* hammer\n* nails (large)\n* paint\n* brush\n* ladder",
        "1. Open the lid.\n2. Take out the filter\n3. Wash the filter\n4. Close the lid again.",
        "[ ] call the bank\n[ ] new keys\n[ ] stamps\n[ ] milk",
        "apples; old pears; two plums; grapes (red); lemons; new figs; dates; quinces",
        "red wool / green wool / needles / buttons / two zips / black thread / lace",
        "rope,old tent,two lamps,new stove,matches,shared map,two blankets (warm),kettle,old boots,torch,new socks,soap",
        "red wool • two buttons • needles • old thread • lace (white) • ribbon x2 • zip • new scissors • chalk • two pins",
        "lamp,two chairs,old desk (oak),new shelf,rug,shared table,mirror,two stools,small bench,old clock,new vase,curtain x2",
        "tea, green tea, two cups, sugar, old spoons, napkins, new kettle, biscuits, honey",
        "North Gate\nThe Old Mill\nHarbour of Sand\nSeven Lamps\nWinter Street 4\nThe Glass Door",
        "Introduction ..... 3\nThe tools ..... 11\nWood ..... 25\nStone ..... 48",
        "Step 1: Find the valve\nStep 2: Turn it off\nStep 3: Drain the pipe",
    ),
    "table": (
        "name\tyear\tcity\nOld Mill\t1910\tUlm\nTower\t1882\tBern\nGate\t1750\tLyon",
        "id,price,stock\n17,4.50,120\n18,3.95,80\n19,12.00,7\n20,0.99,431",
        "| item | size | price |\n|---|---|---|\n| cup | 3 | 2.50 |\n| plate | 7 | 4.00 |\n| bowl | 5 | 3.10 |",
        "name: Ada | city: Ulm | age: 41 || name: Ben | city: Bern | age: 29 || name: Cy | city: Lyon | age: 35",
        "<table>\n<tr><td>cup</td><td>3</td><td>2.50</td></tr>\n<tr><td>plate</td><td>7</td><td>4.00</td></tr>\n</table>",
        "year   city      score\n1910   Ulm       3.5\n1882   Bern      4.1\n1750   Lyon      2.9",
        "3904;17;5.8;Ulm\n159;38;3.0;Bern\n4319;71;5.3;Lyon\n8990;65;0.5;Graz",
    ),
    "junk": (
        "click here click here click here click here click here click here click here",
        "Start > News > Archive > Contact > Start > Imprint > Print > News > Start > Archive",
        "Account Basket Help Contact Imprint Newsletter Account Sign out Privacy Help Basket Contact Sitemap Imprint",
        "Previous page Print Download Report Feedback Previous page Languages Print Report Download Languages Feedback",
        "&nbsp;&nbsp;</div><div class=\"a1\">function(e){return e.x}</span></div>var a=1;@media(max-width:90px){",
        "qpwo xkzj vmnb;trew yqlk jhgf dsaz;xcvb nmpo iuyt rewq;lkjh gfds",
        "#$%^&*~!@ ~~^^%$ <>|\\ */+= @#$ %^&* ~~\n!@#$ ^^&& **// ++==",
        "kJ8fQ2mZx0LpR7vTnB4wYcD1sHgE6uKaOiN3tXzMbVqWlCrPyFjSdGhA9e5oUIk2==",
        "7f3a9c01 000 55120943\n81bb20de 0000 90317750\n0c44e1f7 00 12904473\n5d6e7f80 000 33019284",
        "3f a0 9c 11 7e 55 d2 08 be c4 61 9f 00 ab 37 e8 14 6d f1 92",
        "Ã¢€ ÃÂÃ â€Â ��� Ã¢ �ÂÃ� â€",
        "👍👍!!😀🔥 🏠!!😀🔥👍 🏠🔥!! 😀",
        "big sale Red Door 2\nbig sale Red Door 2\nbig sale Red Door 2\nbig sale Red Door 2\nbig sale Red Door 2",
    ),
}

#: Common words of the languages of the corpus.
COMMON_WORDS = (
    "the of and to in a is that it for was on as with are be at by this but or from an not which you they have were "
    "one has had there who will can its than then them her his she he we my your their our most more only still into "
    "der die das und ist nicht ein eine den dem mit von zu für auf sich auch es im aber wer wird wurde hier ich als am "
    "le la les des un une et est dans que qui pas plus pour sur avec du au ne se il elle nous ce cette sont mais très "
    "el los las y en por con para una del al lo su pero sin sobre fue como más me no de que"
).split()

STATISTICS = (
    "words",
    "mean_word_length",
    "symbol_ratio",
    "punctuated_lines",
    "common_words",
    "digit_ratio",
    "distinct_words",
    "sentence_words",
    "delimited_lines",
    "bullet_lines",
    "bare_lines",
    "markup_ratio",
    "entry_marks",
    "odd_characters",
    "line_words",
    "short_entries",
    "repeated_pairs",
    "capital_words",
)
#: The statistics that are reported, exact; the mixture is given logs of some and cuts outliers.
REPORTED = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
#: Characters that are measured at once; a longer text is measured by itself, at some 60 bytes a character.
CHUNK_CHARS = 1_000_000

# --- classes of characters -----------------------------------------------------------------------

_INVISIBLE_RANGES = ((0x200B, 0x200F), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0xAD, 0xAD))
_SPACE_RANGES = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_NEWLINES = "\r\x0b\f\x85\u2028\u2029"
_HIRAGANA = ((0x3041, 0x3096), (0x309D, 0x309F))
_KATAKANA = ((0x30A1, 0x30FA), (0x30FD, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF6F), (0xFF71, 0xFF9D))
_HAN = ((0x2E80, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0x20000, 0x323AF))
(_LETTER, _NUMBER, _MARK, _SPACE, _KANA, _CJK, _ODD, _LIGHT, _STOP, _LINE_END, _CLOSER, _WIDE_STOP, _JOINER, _BULLET_SIGN, _DASHED) = (
    1 << i for i in range(15)
)
_WORD = _LETTER | _NUMBER | _MARK


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: class bits, the code that stands for it in lower case, and what it is read as (0: nothing)."""
    n = sys.maxunicode + 1
    bits = np.zeros(n, dtype=np.uint16)
    lower = np.arange(n, dtype=np.uint32)
    read = np.arange(n, dtype=np.uint32)
    by_category = {"Lu": _LETTER, "Ll": _LETTER, "Lt": _LETTER, "Lm": _LETTER, "Lo": _LETTER, "Nd": _NUMBER, "Nl": _NUMBER, "No": _NUMBER}
    by_category |= {"Mn": _MARK | _LIGHT, "Mc": _MARK | _LIGHT, "Me": _MARK | _LIGHT, "So": _ODD, "Sk": _ODD, "Co": _ODD, "Cn": _ODD}
    category = unicodedata.category
    for c in range(0x30000):  # beyond are rare ideographs, tags and private use
        bits[c] = by_category.get(category(chr(c)), 0)
    bits[0x30000:0x323B0], bits[0x323B0:] = _LETTER, _ODD
    for c in np.flatnonzero(bits & _LETTER)[:2_000]:  # alphabets with case come first
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    for ranges, bit in ((_HIRAGANA, _KANA | _CJK), (_KATAKANA, _CJK), (_HAN, _CJK)):
        for a, b in ranges:
            bits[a : b + 1] |= bit
    for signs, bit in (
        (" \t\n\x0b\f\r", _SPACE), ("ÃÂâ€\ufffd", _ODD), (".,!?'’。、", _LIGHT), (".!?…", _STOP), (".!?…:;。！？", _LINE_END),
        ("\"”’»')]", _CLOSER), ("。！？", _WIDE_STOP), ("'’-", _JOINER), ("•·‣", _BULLET_SIGN), ("-*+•·‣▪◦–—○●▶✓", _DASHED),
    ):
        for c in signs:
            bits[ord(c)] |= bit
    for a, b in _INVISIBLE_RANGES:
        read[a : b + 1] = 0
    for a, b in _SPACE_RANGES:
        read[a : b + 1] = 32
    for c in _NEWLINES:
        read[ord(c)] = 10
    return bits, lower, read


#: Random odd numbers by the place of a character in its word, for hashes of words.
_POWERS = np.random.default_rng(11).integers(1, 2**63, size=1024, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _MIX
    return x ^ (x >> np.uint64(29))


def _word_hashes(codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each word; ``codes`` holds the characters of all words, one after another."""
    place = np.arange(len(codes)) - np.repeat(starts, counts)
    values = _scramble(codes.astype(np.uint64)) * _POWERS[place & 1023]
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(COMMON_WORDS).encode("utf-32-le"), dtype=np.uint32)
    counts = np.array([len(w) for w in COMMON_WORDS])
    return np.unique(_word_hashes(joined, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts))


_BULLET = re.compile(
    r"\s*(?:[-*+•·‣▪◦–—○●▶✓]\s+|\(?\d{1,3}[.)]\s|\(?[A-Za-z][.)]\s|\[[ xX]?\]|[Ss]tep\s+\d+|#\d+|\d{1,3}\s*[-–:]\s)", re.ASCII
)
_CONTENTS = re.compile(r"\.{3,}\s*\d+\s*$", re.ASCII)
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&[a-z#0-9]+;|[{}=<>;]")


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _distinct(docs: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each document has."""
    mixed = (keys ^ _scramble(docs.astype(np.uint64) + np.uint64(77))) * _MIX
    return np.bincount(docs[np.unique(mixed, return_index=True)[1]], minlength=n).astype(float)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The statistics of some texts, as the mixture takes them (``STATISTICS``), exact (``REPORTED``, with a prefix), and ``blank``.

    Characters are classified once, by a table; everything else is counting over the classes.
    """
    n = len(texts)
    table, lower, read = _alphabet()
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    doc = np.concatenate([[0], np.repeat(np.arange(n), sizes + 1)])  # a text and the line end after it
    code = read[raw]
    keep = code > 0
    keep[:-1] &= ~((raw[:-1] == 13) & (raw[1:] == 10))
    code, doc = code[keep], doc[keep]
    bits = table[code]
    ends_of = np.concatenate([np.flatnonzero(doc[1:] != doc[:-1]), [len(doc) - 1]]) if n > 1 else np.array([len(doc) - 1])
    begins = np.concatenate([[1], ends_of[:-1] + 1])
    length = (ends_of - begins).astype(float)

    def sums(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(flag)  # cheaper than running sums, since most classes are rare
        return (np.searchsorted(places, b) - np.searchsorted(places, a)).astype(float)

    def of_docs(flag: np.ndarray) -> np.ndarray:
        return sums(flag, begins, ends_of)

    def has(bit: int) -> np.ndarray:
        return (bits & bit) != 0

    def shifted(flag: np.ndarray, by: int) -> np.ndarray:
        """What ``flag`` is ``by`` places further on."""
        out = np.zeros_like(flag)
        if by > 0:
            out[:-by] = flag[by:]
        else:
            out[-by:] = flag[:by]
        return out

    is_ = lambda sign: code == ord(sign)
    space, word = has(_SPACE), has(_WORD)
    blank_sign, newline = is_(" "), is_("\n")
    letters, numbers, visible = of_docs(has(_LETTER)), of_docs(has(_NUMBER)), of_docs(~space)
    kana, cjk = of_docs(has(_KANA)), of_docs(has(_CJK))
    # Words: runs of letters, marks and digits, joined by single apostrophes and hyphens.
    inside = word | (has(_JOINER) & shifted(word, -1) & shifted(word, 1))
    first = inside & ~shifted(inside, -1)
    word_at = np.flatnonzero(first)
    word_doc = doc[word_at]
    within = np.flatnonzero(inside)
    starts = np.searchsorted(within, word_at)
    counts = np.diff(np.concatenate([starts, [len(within)]]))
    hashes = _word_hashes(lower[code[within]], starts, counts)
    n_words = np.bincount(word_doc, minlength=n).astype(float)
    listed = _common_hashes()
    place = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    common = np.bincount(word_doc[listed[place] == hashes], minlength=n).astype(float)
    same = word_doc[1:] == word_doc[:-1]
    pairs = (hashes[:-1] * _POWERS[0] + hashes[1:])[same]
    # Ends of sentences: the mark, closing signs, then white space.
    closer = has(_CLOSER)
    at = np.arange(len(code))
    after = np.minimum.accumulate(np.where(closer, len(code) - 1, at)[::-1])[::-1]  # next place that is no closing sign
    follows = shifted(space[after], 1)
    ends = of_docs((has(_STOP) & follows) | has(_WIDE_STOP))
    # Lines: between line ends and ' || ', if anything is visible in them.
    bar = is_("|")
    gap = blank_sign & shifted(bar, 1) & shifted(bar, 2) & shifted(blank_sign, 3)
    parting = newline | gap | shifted(gap, -1) | shifted(gap, -2) | shifted(gap, -3)
    a, b = np.flatnonzero(~parting & shifted(parting, -1)), np.flatnonzero(~parting & shifted(parting, 1)) + 1
    seen = sums(~space, a, b) > 0
    a, b = a[seen], b[seen]
    line_doc, line_length = doc[a], (b - a).astype(float)
    n_lines = np.bincount(line_doc, minlength=n).astype(float)
    total_length = np.bincount(line_doc, weights=line_length, minlength=n)

    def share(flag: np.ndarray) -> np.ndarray:
        return _over(np.bincount(line_doc[flag], minlength=n).astype(float), n_lines)

    def extent(flag: np.ndarray) -> np.ndarray:
        """Share of the text's characters in the chosen lines: the larger part decides, not the number of lines."""
        return _over(np.bincount(line_doc[flag], weights=line_length[flag], minlength=n), total_length)

    last = np.maximum.accumulate(np.where(space, 0, at))[b - 1]  # last visible place of each line
    bare = np.maximum.accumulate(np.where(closer, 0, at))[last]
    finished = (bare >= a) & ((bits[bare] & _LINE_END) != 0)
    stopped = np.isin(code[last], [ord(c) for c in ".!?。！？"])
    token = ~space & shifted(space, -1)
    tokens = sums(token, a, b) + ~space[a] * (~shifted(space, -1)[a])  # a line after ' || ' starts after a space already
    runs = blank_sign & ~shifted(blank_sign, -1) & shifted(blank_sign, 1)
    cell = is_("<") & shifted(is_("/"), 1) & shifted(is_("t"), 2) & shifted(is_("d") | is_("h"), 3) & shifted(is_(">"), 4)
    label = is_(":") & shifted(blank_sign, 1) & shifted(word | blank_sign, -1)
    line_starts = np.concatenate([[0], np.cumsum(n_lines)[:-1]]).astype(np.int64)
    delimited = np.zeros(n)
    for flag in (is_("\t"), bar, is_(","), is_(";"), runs, cell, label):
        held = sums(flag, a, b)
        if held.any():
            # Extent of the lines that hold a delimiter as often as the middle line does.
            ordered = held[np.lexsort((held, line_doc))]
            middle = np.zeros(n)
            several = n_lines > 1
            middle[several] = ordered[line_starts[several] + (n_lines[several] // 2).astype(np.int64)]
            regular = (held == middle[line_doc]) & (middle[line_doc] > 0)
            delimited = np.maximum(delimited, extent(regular))
    # Bullets: a pattern, for the lines that start like one.
    visible_at = np.minimum.accumulate(np.where(space, len(code) - 1, at)[::-1])[::-1]
    head = visible_at[a]
    sign, next_sign = code[head], code[np.minimum(head + 1, len(code) - 1)]
    ascii_letter = ((sign | 32) >= 97) & ((sign | 32) <= 122)
    maybe = ((bits[head] & (_DASHED | _NUMBER)) != 0) | np.isin(sign, [ord(c) for c in "([#"])
    maybe |= ascii_letter & ((next_sign == 46) | (next_sign == 41) | (((sign | 32) == 115) & (next_sign == 116)))
    leader = is_(".") & shifted(is_("."), 1) & shifted(is_("."), 2)
    contents = (sums(leader, a, b) > 0) & ((bits[last] & _NUMBER) != 0)
    bullets = np.zeros(len(a), dtype=bool)
    for k in np.flatnonzero(maybe | contents):
        line = code[a[k] : b[k]].tobytes().decode("utf-32-le", "surrogatepass")
        bullets[k] = bool(_BULLET.match(line)) or bool(contents[k] and _CONTENTS.search(line))
    # Markup: simple signs are counted, tags and entities matched in the texts that may have them.
    markup = of_docs(is_("{") | is_("}") | is_("=") | is_("<") | is_(">") | is_(";"))
    for k in np.flatnonzero(of_docs(is_("<") | is_("&")) > 0):
        text = code[begins[k] : ends_of[k]].tobytes().decode("utf-32-le", "surrogatepass")
        markup[k] = sum(len(m) for m in _MARKUP.findall(text))
    spaced = lambda c: is_(c) & shifted(blank_sign, 1)
    around = lambda c: spaced(c) & shifted(blank_sign, -1)
    dots = leader & ~shifted(is_("."), -1)
    marks = (spaced(";"), around("/"), around(">"), around("»"), spaced("|"), dots, runs, is_("→") | is_("•") | is_("·"))
    # Entries: between lines, commas, semicolons, spaced slashes and bullets.
    comma = is_(",") & ~shifted((code >= 48) & (code <= 57), 1)
    border = newline | comma | is_(";") | around("/") | has(_BULLET_SIGN)
    filled = ~(space | border)
    entry_a, entry_b = np.flatnonzero(~border & shifted(border, -1)), np.flatnonzero(~border & shifted(border, 1)) + 1
    entry_tokens = sums(filled & ~shifted(filled, -1), entry_a, entry_b)
    entry_doc, entry_tokens = doc[entry_a][entry_tokens > 0], entry_tokens[entry_tokens > 0]
    entries = np.bincount(entry_doc, minlength=n).astype(float)
    words = n_words + cjk / 2
    unspaced = cjk > letters * 0.3
    mean = _over(letters + numbers, words)
    usual = np.where(unspaced, _over(kana, cjk), _over(common, n_words))
    found = {
        "words": np.log1p(words),
        "mean_word_length": np.minimum(mean, 20.0),
        "symbol_ratio": _over(visible - letters - numbers - of_docs(has(_LIGHT)), visible),
        "punctuated_lines": share(finished),
        "common_words": np.where(unspaced, np.minimum(usual, 0.45), usual),
        "digit_ratio": _over(numbers, visible),
        "distinct_words": _over(_distinct(word_doc, hashes, n), np.sqrt(n_words)),
        "sentence_words": np.minimum(words / (ends + 1), 60.0),
        "delimited_lines": delimited,
        "bullet_lines": extent(bullets),
        "bare_lines": extent((tokens <= 7) & ~stopped),
        "markup_ratio": _over(markup, length),
        "entry_marks": _over(sum(of_docs(m) for m in marks), n_words),
        "odd_characters": _over(of_docs(has(_ODD)), visible),
        "line_words": np.log1p(_over(n_words, n_lines)),
        "short_entries": _over(np.bincount(entry_doc[entry_tokens <= 4], minlength=n).astype(float), entries),
        "repeated_pairs": np.where(
            n_words > 2, 1 - _distinct(word_doc[1:][same], pairs, n) / np.maximum(n_words - 1, 1), 0.0
        ),
        "capital_words": _over(np.bincount(word_doc[lower[code[word_at]] != code[word_at]], minlength=n).astype(float), n_words),
    }
    found |= {"exact_word_count": np.rint(words), "exact_mean_word_length": mean, "exact_common_words": usual, "blank": visible == 0}
    return found | {f"exact_{s}": found[s] for s in ("symbol_ratio", "punctuated_lines")}


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``blank``, ``features``, the columns of ``REPORTED``) of every row.

    ``features`` packs the values of ``STATISTICS`` into one binary, which is all that a pass of EM reads.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chunk = CHUNK_CHARS

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + chunk, side="right")))
                part = batch.slice(at, to - at)
                got = measure(part.column(1).to_pylist())
                packed = np.ascontiguousarray(np.stack([np.round(got[s], 6) for s in STATISTICS], axis=1))
                width = packed.shape[1] * 8
                offsets = pa.py_buffer(np.arange(len(packed) + 1, dtype=np.int32) * width)
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(got["blank"]),
                        pa.Array.from_buffers(pa.binary(), len(packed), [None, offsets, pa.py_buffer(packed)]),
                        pa.array(got["exact_word_count"].astype(np.int64)),
                        *[pa.array(np.floor(got[f"exact_{s}"] * 1e6 + 0.5) / 1e6) for s in REPORTED[1:]],
                    ],
                    names=["id", "blank", "features", *REPORTED],
                )
                at = to

    kind = rows.schema["id"].dataType.simpleString()
    reported = ", ".join(f"{s} double" for s in REPORTED[1:])
    return rows.mapInArrow(statistics, f"id {kind}, blank boolean, features binary, word_count long, {reported}")


def unpack(features: pa.Array) -> np.ndarray:
    """The packed statistics as a matrix."""
    if not len(features):
        return np.zeros((0, len(STATISTICS)))
    first = np.frombuffer(features.buffers()[1], dtype=np.int32)[features.offset]
    return np.frombuffer(features.buffers()[2], dtype=np.float64, count=len(features) * len(STATISTICS), offset=int(first)).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Mixture:
    """Means, variances and weights of standardised statistics, and the kind of every component."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    weights: np.ndarray
    kinds: tuple[str, ...]

    def standardise(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CLIP, CLIP)

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The share of each component in each row, and each row's log-likelihood (without its constant)."""
        log = np.log(self.weights) - 0.5 * np.log(self.variances).sum(1)
        precision = 1 / self.variances
        log = log - 0.5 * (z**2 @ precision.T - 2 * z @ (self.means * precision).T + (self.means**2 * precision).sum(1))
        top = log.max(axis=1, keepdims=True)
        r = np.exp(log - top)
        total = r.sum(axis=1, keepdims=True)
        return r / total, (top + np.log(total)).ravel()

    def kind_shares(self, x: np.ndarray) -> np.ndarray:
        r, _ = self.responsibilities(self.standardise(x))
        return np.stack([r[:, [k == kind for k in self.kinds]].sum(1) for kind in KINDS], axis=1)


def _seeds(points: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first centres of one kind's examples, improved by a few rounds of averaging."""
    centres = [points[((points - np.median(points, axis=0)) ** 2).sum(1).argmin()]]
    while len(centres) < min(k, len(points)):
        nearest = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[nearest.argmax()])
    found = np.array(centres)
    for _ in range(10):
        own = ((points[:, None] - found[None]) ** 2).sum(2).argmin(1)
        found = np.array([points[own == j].mean(0) if (own == j).any() else found[j] for j in range(len(found))])
    return found


def _examples(stats: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    texts = [(kind, text) for kind, many in EXAMPLES.items() for text in many]
    got = measure([t for _, t in texts])
    x = np.stack([np.round(got[s], 6) for s in STATISTICS], axis=1)
    kinds = np.array([k for k, _ in texts])
    if labels is None:
        return x, kinds
    known = labels.filter(F.lower(F.trim("kind")).isin(*KINDS)).groupBy(F.col("doc_id").alias("id")).agg(
        F.mode(F.lower(F.trim("kind")), True).alias("kind")
    )
    known = known.orderBy("id").limit(MAX_LABELLED)
    one = stats.filter("not blank").join(F.broadcast(known), "id").groupBy("id", "kind").agg(F.min("features").alias("features"))
    found = one.orderBy("id").toArrow()
    if not found.num_rows:
        return x, kinds
    own = np.frombuffer(b"".join(found["features"].to_pylist()), dtype=np.float64).reshape(-1, len(STATISTICS))
    return np.vstack([x, own]), np.concatenate([kinds, np.array(found["kind"].to_pylist())])


def _without_outliers(z: np.ndarray, kinds: np.ndarray, fixed: int) -> np.ndarray:
    """Which examples to keep: a label is dropped if its three nearest examples all have another kind in common."""
    keep = np.ones(len(z), dtype=bool)
    norm = (z**2).sum(1)
    for at in range(fixed, len(z), 512):
        rows = np.arange(at, min(at + 512, len(z)))
        distance = norm[None, :] - 2 * z[rows] @ z.T
        distance[np.arange(len(rows)), rows] = np.inf
        near = kinds[np.argpartition(distance, 3, axis=1)[:, :3]]
        keep[rows] = ~((near == near[:, :1]).all(1) & (near[:, 0] != kinds[rows]))
    return keep


def _added_up(points: DataFrame, columns: int, rows_of) -> np.ndarray:
    """The sum over all rows of ``rows_of(statistics)``, a matrix; added up in each task first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = rows_of(unpack(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch({"j": np.arange(len(total)), "v": pa.array(list(total), pa.list_(pa.float64()))})

    names = [F.sum(F.get("v", F.lit(i))).alias(f"c{i}") for i in range(columns)]
    found = points.mapInArrow(partial, "j long, v array<double>").groupBy("j").agg(*names).orderBy("j").toArrow()
    return np.stack([found[f"c{i}"].to_numpy() for i in range(columns)], axis=1) if found.num_rows else np.zeros((0, columns))


def fit_mixture(stats: DataFrame, labels: DataFrame | None = None) -> Mixture:
    """EM over all rows of ``stats`` that are not blank, until a pass gains less than ``TOLERANCE`` a row."""
    d = len(STATISTICS)
    points = stats.filter("not blank").select("features")

    def moments(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])[None, :]

    found = _added_up(points, 1 + 2 * d, moments)
    x, kinds = _examples(stats, labels)
    n = found[0, 0] if len(found) else 0
    if n:
        centre = found[0, 1 : 1 + d] / n
        scale = np.sqrt(np.maximum(found[0, 1 + d :] / n - centre**2, 1e-12))
    else:
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -CLIP, CLIP)
    keep = _without_outliers(z, kinds, sum(map(len, EXAMPLES.values())))
    z, kinds = z[keep], kinds[keep]
    seeds = {k: _seeds(z[kinds == k], COMPONENTS[k]) for k in KINDS}
    origin = np.concatenate([[k] * len(seeds[k]) for k in KINDS])
    first = np.vstack([seeds[k] for k in KINDS])
    share = np.concatenate([[max((kinds == k).sum(), 1) / len(seeds[k])] * len(seeds[k]) for k in KINDS])
    model = Mixture(centre, scale, first, np.full_like(first, 0.5), share / share.sum(), tuple(origin))
    before = -np.inf
    for _ in range(MAX_STEPS if n else 0):

        def expected(x: np.ndarray, model: Mixture = model) -> np.ndarray:
            z = model.standardise(x)
            r, log = model.responsibilities(z)
            likelihood = np.zeros(len(model.kinds))
            likelihood[0] = log.sum()
            return np.hstack([likelihood[:, None], r.sum(0)[:, None], r.T @ z, r.T @ z**2])

        sums = _added_up(points, 2 + 2 * d, expected)
        weight = sums[:, 1:2] + SEED_COUNT + 1e-9
        means = (sums[:, 2 : 2 + d] + SEED_COUNT * first) / weight
        squares = (sums[:, 2 + d :] + SEED_COUNT * (first**2 + 0.5)) / weight
        variances = np.maximum(squares - means**2, 0) + VARIANCE_FLOOR
        model = Mixture(centre, scale, means, variances, (weight / weight.sum()).ravel(), tuple(origin))
        gain, before = sums[0, 0] / n - before, sums[0, 0] / n
        if gain < TOLERANCE:
            break
    else:
        if n:
            warnings.warn(f"the mixture still gained {gain:.2g} a row after {MAX_STEPS} passes", stacklevel=2)
    votes = np.stack([model.responsibilities(z)[0][kinds == k].sum(0) for k in KINDS], axis=1)
    votes += 1e-3 * (origin[:, None] == np.array(KINDS)[None, :])
    return Mixture(
        centre, scale, model.means, model.variances, model.weights, tuple(KINDS[j] for j in votes.argmax(1))
    )


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the five statistics uncut (``word_count`` first), ``kind`` (null for blank texts) and ``certainty``."""
    stats = reliable_checkpoint(text_statistics(docs, id_col, text_col))
    model = fit_mixture(stats, labels)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = model.kind_shares(unpack(batch.column(2)))
            kind = np.array(KINDS, dtype=object)[shares.argmax(1)]
            kind[batch.column(1).to_numpy(zero_copy_only=False)] = None
            columns = [batch.column(0), *batch.columns[3:], pa.array(kind, pa.string()), pa.array(shares.max(1))]
            yield pa.record_batch(columns, names=["id", *REPORTED, "kind", "certainty"])

    kind_of_id = stats.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{c} double" for c in REPORTED[1:])
    decided = stats.mapInArrow(decide, f"id {kind_of_id}, word_count long, {columns}, kind string, certainty double")
    return decided.withColumnRenamed("id", id_col)
