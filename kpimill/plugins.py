"""Places where programs that are no table operations plug in, with offline defaults.

A plug-in turns columns into a column, or files into rows; the defaults use built-in functions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PageParser(Protocol):
    """The pages of a document file; a file that can't be parsed gives none."""

    def __call__(self, content: bytes) -> list[str]: ...


class NameRecogniser(Protocol):
    """An array of person names for a text column."""

    def column(self, text: Column) -> Column: ...


@dataclass
class ListedNames:
    """Recognises the names of a list."""

    names: tuple[str, ...]

    def column(self, text: Column) -> Column:
        return F.filter(F.array(*map(F.lit, self.names)).cast("array<string>"), lambda n: F.contains(text, n))


def split_form_feeds(content: bytes) -> list[str]:
    """The default parser: UTF-8 text with a form feed between pages."""
    return content.decode("utf-8", "replace").split("\f")


@dataclass
class Tokenizer:
    """Counts tokens; white space parts them unless ``encode`` is given."""

    encode: Callable[[str], list] | None = None

    def count(self, text: Column) -> Column:
        if self.encode is None:
            return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")
        encode = self.encode

        @F.pandas_udf(T.LongType())
        def n(s):  # noqa: ANN001
            return s.map(lambda t: len(encode(t)) if t is not None else 0)

        return n(text)


def encoding_name(model: str) -> str:
    """The vocabulary of a model's family."""
    import re

    m = model.lower()
    if re.match(r"gpt-5|gpt-4o|o\d", m):
        return "o200k_base"
    if re.match(r"gpt-4|gpt-3\.5", m):
        return "cl100k_base"
    return "o200k_base"


@dataclass
class Retry:
    """Calls again after passing failures, waiting ``delay`` seconds, then twice that, and so on."""

    attempts: int = 5
    delay: float = 1.5
    passing: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError)
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __call__(self, call: Callable[[], str]) -> str:
        for k in range(self.attempts):
            try:
                return call()
            except self.passing as e:
                if k == self.attempts - 1:
                    raise RuntimeError(f"no answer after {self.attempts} attempts") from e
                self.sleep(self.delay * 2**k)
        raise RuntimeError("no attempt was allowed")


def temperature(model: str) -> float:
    """Models of the fifth generation accept no other than 1."""
    return 1.0 if "gpt-5" in model.lower() else 0.3


class Extractor(Protocol):
    """The answer text (a finding tree as JSON) for a chunk of a document."""

    def __call__(self, chunk: str, year: int | None, metrics: list[str]) -> str: ...
