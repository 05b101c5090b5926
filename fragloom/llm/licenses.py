"""License scan: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fragloom.llm.common import texts

# Phrases whose places count, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices; their labels join the result, their places do not count as base places.
EXTRA_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "the isc license": "isc",
    "cc0 1 0 universal": "cc0",
}
# Identifier tags: the line goes on with an expression.
TAGS = ("spdx-license-identifier:",)
TAG_WORDS = "spdx license identifier"
# Identifiers that allow use without further terms; used to evaluate expressions.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "isc", "mit", "unlicense", "zlib")
# Identifiers that name the same licence as a base label.
SAME = {"apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc"}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|[^\s()]")
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*\Z")
# Words are runs of digits, a-z and characters beyond ASCII after A-Z are lower-cased.
FOLD = {c: " " for c in range(128)} | {c: chr(c) for r in ((48, 58), (97, 123)) for c in range(*r)} | {c: chr(c + 32) for c in range(65, 91)}


def parse(expression: str, permissive=PERMISSIVE) -> tuple[set[str], bool] | None:
    """Licence identifiers of an expression and whether it can be met with permissive ones only.

    ``or`` is met if one side is, ``and`` if both are, ``x with exception`` if x is. None if malformed.
    Operators go through a stack by precedence; operands are (identifiers, met) pairs.
    """
    operands: list[tuple[set[str], bool]] = []
    operators: list[str] = []

    def apply() -> bool:
        op = operators.pop()
        if op == "(" or len(operands) < 2:
            return False
        (b, b_met), (a, a_met) = operands.pop(), operands.pop()
        if op == "with":
            operands.append((a, a_met))
        else:
            operands.append((a | b, a_met or b_met if op == "or" else a_met and b_met))
        return True

    want_operand = True
    for raw in TOKEN.findall(expression):
        token = raw.lower()
        if token == "(":
            if not want_operand:
                return None
            operators.append(token)
        elif token == ")":
            if want_operand:
                return None
            while operators and operators[-1] != "(":
                if not apply():
                    return None
            if not operators:
                return None
            operators.pop()
        elif token in PRECEDENCE:
            if want_operand:
                return None
            while operators and PRECEDENCE.get(operators[-1], 0) >= PRECEDENCE[token]:
                if not apply():
                    return None
            operators.append(token)
            want_operand = True
        else:
            if not want_operand or not IDENTIFIER.match(token):
                return None
            operands.append(({token}, token in permissive))
            want_operand = False
    while operators:
        if not apply():
            return None
    return operands[0] if len(operands) == 1 and not want_operand else None


def bare(line: str) -> str:
    """A line without white space around it and without signs and comment ends behind it."""
    while True:
        cut = line.strip().rstrip("\"'*#;,. \t")
        cut = cut.removesuffix("*/").removesuffix("-->")
        if cut == line:
            return cut
        line = cut


def looks_licensed(name: str) -> bool:
    return name in PERMISSIVE or name in SAME or name.startswith("licenseref-") or name.endswith("-exception") or any(c.isdigit() for c in name)


def leading(line: str) -> str:
    """The longest well-formed expression that a line begins with, empty without one.

    Where a plain word follows it, as in ``see the file``, only operands that look like licences count: known ones and
    those with a digit, ``LicenseRef-`` or ``-exception``. A sign behind an expression ends it whatever its operands are.
    """
    depth, want_operand, licensed, end, last = 0, True, True, 0, 0
    for m in TOKEN.finditer(line):
        token = m[0].lower()
        if want_operand and token == "(":
            depth += 1
        elif want_operand:
            name = token.rstrip(".:-") if depth == 0 else token
            if name in PRECEDENCE or not IDENTIFIER.match(name):
                break
            want_operand, licensed, last = False, licensed and looks_licensed(name), m.start() + len(name)
            if name != token:
                return line[:last]
        elif token == ")" and depth:
            depth, last = depth - 1, m.end()
        elif token in PRECEDENCE:
            want_operand = True
        else:
            return line[:last] if depth == 0 and not token[0].isalnum() and token != "(" else line[:end]
        if depth == 0 and not want_operand and licensed:
            end = last
    return line[:end]


def automaton(base: dict[str, str], extra: dict[str, str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", base), ("extra", extra), ("tag", {TAG_WORDS: ""})):
        for phrase, label in phrases.items():
            old = found.get(f" {phrase} ", [])
            found.add_word(f" {phrase} ", [*old, (kind, phrase.count(" ") + 1, label)])
    found.make_automaton()
    return found


def scan_text(text: str | None, found) -> tuple:
    """One text's row: words, base places, first and last start, base labels, all labels, expressions, usable, score."""
    folded = (text or "").translate(FOLD)
    parts = [w for w in folded.split(" ") if w]
    line = f" {' '.join(parts)} "
    n_base, first, last, strength, tagged = 0, None, None, 0, False
    base: set[str] = set()
    extra: set[str] = set()
    at, spaces = 0, 0
    for end, hits in found.iter(line):
        spaces += line.count(" ", at, end + 1)
        at = end + 1
        for kind, size, label in hits:
            start = spaces - 1 - size
            if kind == "base":
                n_base += 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
                base.add(label)
            elif kind == "extra":
                extra.add(label)
            else:
                tagged = True
                continue
            strength += 1
    expressions, met = [], []
    if tagged:
        for tag in TAGS:
            for m in re.finditer(re.escape(tag) + r"([^\n\r]*)", text or "", re.IGNORECASE):
                expression = bare(m[1])
                result = parse(expression)
                if result is None:
                    expression = leading(expression).strip()
                    result = parse(expression)
                if result is not None:
                    expressions.append(expression)
                    extra |= {SAME.get(x, x) for x in result[0]}
                    met.append(result[1])
    score = 1.0 if expressions else 1.0 - 0.5 ** min(strength, 50)
    return len(parts), n_base, first, last, sorted(base), sorted(base | extra), expressions, all(met) if met else None, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """Licence evidence per row, whole texts, no shuffle.

    Returns id, ``n_words``, ``n_base`` (all places of base phrases), ``first_word``/``last_word`` (starts, from 0),
    ``base_labels``, ``labels`` (arrays, distinct and sorted), ``expressions`` (the longest well-formed ones after identifier tags),
    ``usable`` (all expressions met by permissive licences; null without one) and ``score``: 1 with an expression,
    else 1 - 2^-places, 0 without evidence. Null and empty texts give zeros, nulls and empty lists; rows with equal
    or null ids stay separate rows; other columns are not read.
    """
    base, extra = base or BASE_PHRASES, EXTRA_PHRASES if extra is None else extra
    rows = texts(docs, id_col, text_col).withColumnRenamed("_id", id_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(base, extra)
        for batch in batches:
            out = [scan_text(t, found) for t in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.float64())
            cols = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))],
                [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "usable", "score"],
            )

    return rows.mapInArrow(
        scan,
        f"`{id_col}` {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "labels array<string>, expressions array<string>, usable boolean, score double",
    )
