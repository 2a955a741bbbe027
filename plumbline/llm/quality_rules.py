"""Line-first cleaning: every line is judged on its own, failing lines go, documents that lose too much text go.

The line rules (a line has words; a word is a run without ASCII white space):
  separators   more than two words, at least a fifth of them menu separators
  symbols      symbol characters are at least a tenth of the characters of its words
  shouting     "!!" at least once for every two words
  no sentence  ten words or more without . ! ? or an ellipsis
  boilerplate  a phrase of menus, banners and notices
  repeated     equal to an earlier line of the document
"""

import re
from collections import Counter

from pyspark.sql import DataFrame

from plumbline.llm.common import WORD, per_document, text_of

SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(["|", "»", "•", "·", ">"])
SENTENCE_END = re.compile("[.!?…]")
BOILERPLATE = re.compile("(?i)accept (all )?cookies|use of cookies|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe to our|enable javascript|skip to content")
#: Documents shorter than this, or with more than this share of repeated words, fail the base; more than this share of
#: word characters lost with their lines and the method rejects them.
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 50


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that are found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def line_fails(line: str, words: list[str], chars: int) -> bool:
    n = len(words)
    return (
        (n > 2 and 5 * sum(w in SEPARATORS for w in words) >= n)
        or 10 * sum(map(line.count, SYMBOLS)) >= chars
        or 2 * line.count("!!") >= n
        or (n >= 10 and SENTENCE_END.search(line) is None)
        or BOILERPLATE.search(line) is not None
    )


def clean_lines(text: str):
    """(lines kept, repeated lines, word characters of all lines, of removed lines). Lines without a word are kept."""
    kept, seen, repeated, total, lost = [], set(), 0, 0, 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if words:
            chars = sum(map(len, words))
            total += chars
            again = line in seen
            repeated += again
            seen.add(line)
            if again or line_fails(line, words, chars):
                lost += chars
                continue
        kept.append(line)
    return kept, repeated, total, lost


def quality_rules(df: DataFrame, id_col="doc_id", text_col="text", with_text=False) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost.

    `with_text` adds `cleaned`, the text without its failing lines. A null or empty text has no words: it fails the base.
    Rows are judged on their own, whole, however long: repeated rows and null ids come out as often as they came in,
    other columns are ignored.
    """

    def make():
        def row(text):
            words = WORD.findall(text)
            n, again = len(words), repeated_words(words)
            lines, dup, chars, lost = clean_lines(text)
            failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
            cells = n, chars, sum(map(text.count, SYMBOLS)), dup, again, failed, not failed and 100 * lost <= MOST_LOST * chars, lost
            return (*cells, "\n".join(lines)) if with_text else cells

        return row

    ddl = "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,n_lost long"
    return per_document(text_of(df, id_col, text_col), ddl + ",cleaned string" * with_text, make)
