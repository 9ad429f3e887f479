"""Which phrases of a bounded list occur in texts as whole words: one pass over each text, by its words and by an automaton."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


class Phrases:
    """Phrases of word characters only, looked up by the words of a text; for all others, an Aho-Corasick
    automaton with what must stand on either side of each.

    A single word occurs as a whole word exactly where the text has it between two others.  In the
    automaton, short ones would match inside nearly every word of a text.
    """

    _WORD = re.compile(r"\w+")

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self._words = {p for p in phrases if all(map(_is_word, p))}
        self._automaton = ahocorasick.Automaton()
        for p in phrases:
            if p not in self._words:
                self._automaton.add_word(p, (p, len(p), _is_word(p[0]), _is_word(p[-1])))
        if len(self._automaton):
            self._automaton.make_automaton()

    def inside(self, text: str) -> set[str]:
        found = self._words.intersection(self._WORD.findall(text)) if self._words else set()
        if not len(self._automaton):
            return found
        last = len(text) - 1
        for end, (phrase, length, word_first, word_last) in self._automaton.iter(text):
            if phrase in found:
                continue
            begin = end - length + 1
            before = begin > 0 and _is_word(text[begin - 1])
            after = end < last and _is_word(text[end + 1])
            # A boundary lies between a word character and another or none.
            if before != word_first and after != word_last:
                found.add(phrase)
        return found


def texts_with(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n) by tasks: in how many of ``texts`` (text) each phrase occurs; the caller sums them up.

    ``phrases`` (phrase) come to the driver and from there to the tasks: bound them.
    """
    held = texts.sparkSession.sparkContext.broadcast(phrases.toArrow().column("phrase").to_pylist())

    def work(batches: Iterator[pa.RecordBatch]):
        if not held.value:
            return
        automaton, n = Phrases(held.value), Counter()
        for batch in batches:
            for text in batch.column("text"):
                n.update(automaton.inside(text.as_py()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["phrase", "n"])

    return texts.mapInArrow(work, "phrase string, n long")
