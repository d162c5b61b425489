"""Wording rules as data: phrases that need a context, phrases that are replaced, and marks of unfinished text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Phrase:
    """A phrase that a text must not hold, unless it holds one of the ``allowed`` contexts too; case does not matter."""

    phrase: str
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mark:
    """A mark of unfinished text: a ``word`` (not within other words), a ``term`` anywhere, or a ``pattern``; case matters for patterns only."""

    kind: str
    text: str

    @property
    def pattern(self) -> str:
        if self.kind == "word":
            return rf"(?i)(^|[^A-Za-z0-9_]){re.escape(self.text)}([^A-Za-z0-9_]|$)"
        if self.kind == "term":
            return f"(?i){re.escape(self.text)}"
        if self.kind == "pattern":
            return self.text
        raise ValueError(f"no such kind of mark: {self.kind}")


def forbidden_phrases(frame: DataFrame, keys: Sequence[str], text: str, phrases: Sequence[Phrase]) -> DataFrame:
    """A row (keys, phrase, occurrences) for each forbidden phrase of each text, in one pass and without a shuffle.

    Occurrences do not overlap.  A null or empty text breaks nothing.
    """
    low = F.lower(F.col(text))
    found = []
    for p in phrases:
        lost = F.char_length(low) - F.char_length(F.replace(low, F.lit(p.phrase.lower()), F.lit("")))
        n = (lost / len(p.phrase)).cast("long")
        excused = F.lit(False)
        for context in p.allowed:
            excused = excused | low.contains(context.lower())
        found.append(F.struct(F.lit(p.phrase).alias("phrase"), F.when(excused, F.lit(0)).otherwise(n).cast("long").alias("occurrences")))
    return frame.select(*keys, F.inline(F.filter(F.array(*found), lambda x: x["occurrences"] > 0)))


def controlled(text: Column, replacements: Mapping[str, str], closing: str | None = None) -> Column:
    """``text`` with each phrase replaced, in order, as it stands and with capitals; ``closing`` is put at the end where the text lacks it.

    A later phrase also meets what an earlier one put in.  Null stays null.
    """
    for phrase, plain in replacements.items():
        for form in dict.fromkeys((phrase, phrase.title())):
            text = F.replace(text, F.lit(form), F.lit(plain))
    if closing:
        text = F.when(text.contains(closing), text).otherwise(F.concat(text, F.lit(" "), F.lit(closing)))
    return text


def unfinished(frame: DataFrame, keys: Sequence[str], text: str, marks: Sequence[Mark]) -> DataFrame:
    """A row (keys, kind, mark) for each mark that a text holds, in one pass and without a shuffle; a null text holds none."""
    found = [F.when(F.col(text).rlike(m.pattern), F.struct(F.lit(m.kind).alias("kind"), F.lit(m.text).alias("mark"))) for m in marks]
    return frame.select(*keys, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
