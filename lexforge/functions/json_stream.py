"""The answer field of a model's reply while its JSON is still arriving."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The field that is shown, and JSON's escapes of one letter.
FIELD = "reponse"
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_HIGH, _LOW = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
#: A run of plain characters, a pair of surrogates, one surrogate that the next escape shows to be alone, or an escape.
_STEP = re.compile(rf'[^"\\]+|{_HIGH}{_LOW}|{_HIGH}(?=[^\\]|\\[^u]|\\u[0-9a-fA-F]{{4}})|{_LOW}|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{{4}}|\\["\\/bfnrt]')
#: The beginning of an escape, or of two that may be a pair, which what comes next can complete.
_BEGUN = re.compile(rf"\\(?:u[0-9a-fA-F]{{0,3}})?\Z|{_HIGH}(?:\\(?:u[0-9a-fA-F]{{0,3}})?)?\Z")
_GAP = re.compile(r"[ \t\r\n:]*")


@dataclass
class Reader:
    """Where a reply has been read to: "before" the field, "at" its value, "in" it, or "after" all that can be shown; and the
    few characters whose meaning is still open. What was shown is not kept."""

    place: str = "before"
    open: str = ""

    def read(self, fragment: str, field: str = FIELD) -> str:
        """What the next fragment lets be shown."""
        raw, shown, at = self.open + fragment, [], 0
        self.open = ""
        if self.place == "before":
            key = f'"{field}"'
            if (found := raw.find(key)) < 0:
                self.open = raw[-(len(key) - 1) :]
                return ""
            self.place, at = "at", found + len(key)
        if self.place == "at":
            at = _GAP.match(raw, at).end()
            if at == len(raw):
                return ""
            self.place, at = ("in" if raw[at] == '"' else "after"), at + 1
        while self.place == "in" and at < len(raw):
            if _BEGUN.match(raw, at):
                self.open = raw[at:]
                break
            if not (step := _STEP.match(raw, at)):
                self.place = "after"  # the value ends, or something else than JSON stands there
                break
            text = step[0]
            if text.startswith("\\u"):
                units = b"".join(int(x, 16).to_bytes(2, "little") for x in text.split("\\u")[1:])
                shown.append(units.decode("utf-16-le", "replace"))
            else:
                shown.append(ESCAPES[text[1]] if text[0] == "\\" else text)
            at = step.end()
        return "".join(shown)


def partial_value(raw: str | None, field: str = FIELD) -> str:
    """As much of the field's value as has safely arrived: "" before it begins; never part of an escape or of a pair of
    escapes. A surrogate that stands alone is shown as the replacement character."""
    return Reader().read(raw or "", field)


def partial_answer(raw: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([partial_value(x) for x in s], dtype=object), "string")(raw)
