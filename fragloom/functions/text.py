"""Text rules for page elements: equations, tables, captions, headings, categories, wrapping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Symbol -> LaTeX command, applied in this order.
LATEX = {
    "∑": r"\sum", "∫": r"\int", "∏": r"\prod", "∂": r"\partial", "√": r"\sqrt", "α": r"\alpha", "β": r"\beta",
    "γ": r"\gamma", "θ": r"\theta", "λ": r"\lambda", "σ": r"\sigma", "ω": r"\omega", "≈": r"\approx", "≤": r"\le",
    "≥": r"\ge", "±": r"\pm", "≠": r"\neq", "∈": r"\in", "→": r"\to", "∞": r"\infty", "∇": r"\nabla",
}
# Fixed symbols of the short equation detector.
DETECTOR_SYMBOLS = ["\\sum", "\\int", "\\alpha", "\\beta", "\\gamma", "\\theta", "\\lambda", "dx/dt", "±", "≠", "≤", "≥", "∑", "∫"]
# Fixed keywords per document category, in order of precedence.
CATEGORIES = {
    "research_paper": ["abstract", "introduction", "methodology", "references", "results", "discussion", "et al."],
    "invoice": ["invoice", "bill to", "due date", "balance due", "subtotal", "tax", "payment terms"],
    "legal_contract": ["agreement", "terms and conditions", "governing law", "hereby", "parties", "indemnification", "jurisdiction"],
    "financial_report": ["balance sheet", "income statement", "cash flows", "fiscal year", "ebitda", "assets", "liabilities"],
    "technical_specification": ["specification", "requirements", "rfc", "protocol", "architecture", "payload", "interface"],
}
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _contains_any(c: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(c, F.lit(w))
    return cond


def is_equation(text: Column) -> Column:
    """Symbol, numbered formula, or an assignment with an operator and no prose word; 3 characters or more."""
    t = strip(text)
    symbol = _contains_any(t, [*LATEX.values(), *LATEX.keys()])
    numbered = t.rlike(r"=\s*.*?\(\s*[0-9]+(?:\.[0-9]+)?\s*\)$")
    assignment = t.rlike(f"(?<!{WORD})[a-zA-Z]" + r"\s*=\s*[-+]?[\p{L}\p{N}_()^/]+")
    operator = t.rlike(r"[\^_+\-*/]")
    prose = t.rlike(f"(?i)(?<!{WORD})(the|is|are|was|were|we|and|that|this)(?!{WORD})")
    return (F.length(t) >= 3) & (symbol | numbered | (assignment & operator & ~prose))


def equation_detect(text: Column) -> Column:
    """struct(is_equation, is_numbered) of the page-level detector."""
    t = strip(text)
    numbered = t.rlike(r"\A.*?\(\s*[0-9]+(?:\.[0-9]+)?\s*\)\s*\z") & t.rlike(r"[=+\-*/^]")
    return F.struct((_contains_any(t, DETECTOR_SYMBOLS) | numbered).alias("is_equation"), numbered.alias("is_numbered"))


def unicode_to_latex(text: Column) -> Column:
    out = text
    for symbol, command in LATEX.items():
        out = F.replace(out, F.lit(symbol), F.lit(command))
    return out


def equation_parse(text: Column) -> Column:
    """struct(latex, number, kind, tokens): the trailing (n), (n.m) or (A.n) is split off."""
    t = strip(text)
    tail = r"\(\s*([0-9]+(?:\.[0-9]+)?|[A-Z]\.[0-9]+)\s*\)$"
    number = F.nullif(F.regexp_extract(t, tail, 1), F.lit(""))
    latex = unicode_to_latex(strip(F.regexp_replace(t, tail, "")))
    tokens = F.regexp_extract_all(latex, F.lit(r"(\\[A-Za-z]+|[a-zA-Z0-9]+|[^\s\p{L}\p{N}_])"), F.lit(1))
    return F.struct(
        latex.alias("latex"), number.alias("number"), F.when(number.isNotNull(), "NUMBERED").otherwise("DISPLAY").alias("kind"), tokens.alias("tokens")
    )


def doc_category(text: Column) -> Column:
    """struct(category, confidence): most keyword hits, first category on ties."""
    low = F.lower(text)
    hits = [
        F.struct(sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("c"))
        for i, (name, words) in enumerate(CATEGORIES.items())
    ]
    best = F.array_max(F.array(*hits))
    return F.when(
        best["n"] > 0,
        F.struct(best["c"].alias("category"), F.round(F.least(F.lit(0.95), 0.60 + best["n"] * 0.05), 2).alias("confidence")),
    ).otherwise(F.struct(F.lit("general_document").alias("category"), F.lit(0.50).alias("confidence")))


def heading_level(text: Column, size: Column) -> Column:
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    return (
        F.when(size >= 16.0, 1).when((size >= 13.0) & (F.length(text) < 120), 2).when(upper & (F.length(text) < 80), 3).otherwise(0).cast("long")
    )


def figure_caption(text: Column) -> Column:
    """Caption text when the element is a figure caption, else null."""
    t = strip(text)
    return F.when(t.rlike(r"(?i)\A(?:Figure|Fig\.?|Chart|Diagram)\s+[0-9]+[:.]?.*\z"), t)


def image_caption(text: Column) -> Column:
    t = strip(text)
    return F.when(t.rlike(r"(?i)\A(?:Figure|Fig\.?|Diagram|Illustration)\s*[0-9]+"), t)


def detect_table(text: Column) -> Column:
    """Rows of trimmed, non-empty cells when two lines or more hold a pipe or tab; else null."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda s: s != "")
    cells = lambda s: F.filter(
        F.transform(F.when(F.contains(s, F.lit("|")), F.split(s, r"\|", -1)).otherwise(F.split(s, "\t", -1)), strip), lambda c: c != ""
    )
    rows = F.filter(F.transform(lines, cells), lambda r: F.size(r) > 0)
    marked = F.exists(lines, lambda s: F.contains(s, F.lit("|")) | F.contains(s, F.lit("\t")))
    return F.when(marked & (F.size(lines) >= 2) & (F.size(rows) > 0), rows)


def rebuild_table(text: Column, min_rows: int = 2, min_cols: int = 2) -> Column:
    """struct(caption, delimiter, rows padded to the widest, n_rows, n_cols, empty_cells), null without a table."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda s: s != "")
    caption = r"(?i)\A(?:Table|Tab\.)\s*[0-9IVX]+[\s.:\-]*"
    body = F.filter(lines, lambda s: ~s.rlike(caption))
    sample = F.array_join(F.slice(body, 1, 5), "\n")
    wide = lambda s: F.split(s, r"\s{2,}", -1)
    spaced = F.exists(body, lambda s: F.size(wide(s)) >= min_cols)
    delimiter = F.when(F.contains(sample, F.lit("|")), "pipe").when(F.contains(sample, F.lit("\t")), "tab").when(spaced, "spaces")
    pipe_cells = lambda s: F.transform(F.split(F.regexp_replace(F.regexp_replace(s, r"\A\|", ""), r"\|\z", ""), r"\|", -1), strip)
    parse = lambda s: (
        F.when(delimiter == "pipe", pipe_cells(s)).when(delimiter == "tab", F.transform(F.split(s, "\t", -1), strip)).otherwise(F.transform(wide(s), strip))
    )
    rows = F.filter(F.transform(body, parse), lambda r: F.size(r) >= min_cols)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    empty = F.aggregate(padded, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c == "")))
    ok = delimiter.isNotNull() & (F.size(body) >= min_rows) & (F.size(rows) >= min_rows) & (F.size(lines) >= min_rows)
    return F.when(
        ok,
        F.struct(
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(lines, lambda s: s.rlike(caption))), -1).alias("caption"),
            delimiter.alias("delimiter"), padded.alias("rows"), F.size(rows).cast("long").alias("n_rows"), width.cast("long").alias("n_cols"), empty.cast("long").alias("empty_cells"),
        ),
    )


def wrap_text(text: Column, width: int = 80) -> Column:
    """Greedy word wrap as an array of lines; a word longer than ``width`` has a line of its own.

    One regular expression walks the words once: a line is the longest run of whole words that fits, or one long word.
    """
    words = F.trim(F.regexp_replace(text, r"\s+", " "))
    line = r"([^ ]{%d,}|[\s\S]{1,%d})(?: |\z)" % (width + 1, width)
    return F.when(words != "", F.regexp_extract_all(words, F.lit(line), F.lit(1))).otherwise(F.array().cast("array<string>"))
