"""Text scalars as Spark column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that take a hyphen after a word.
HYPHEN_SUFFIXES = [
    "based", "driven", "oriented", "aware", "agnostic", "independent", "dependent", "first", "native", "centric", "intensive", "bound", "safe",
    "free", "proof", "efficient", "optimized", "enabled", "powered", "ready", "capable", "compatible", "compliant", "level", "scale", "wide",
    "specific", "friendly", "facing", "like", "style",
]
#: Words that mark a section title's font.
ANCHOR_WORDS = ["abstract", "introduction", "background", "related work", "method", "methodology", "methods", "experiments", "results", "discussion", "conclusion", "conclusions", "references", "acknowledgments", "acknowledgements", "appendix"]
#: What opens a caption.
CAPTION = r"(?iU)^(?:fig(?:ure)?\.?\s*\d+|table\.?\s*\d+|(?:scheme|algorithm)\.?\s*\d+|listing\.?\s*\d+|(?:appendix\s+)?(?:fig(?:ure)?|table)\.?\s*[a-z]?\d+)"
#: Characters and structures of mathematics (pattern text is common to Java and Python).
MATH_CHARS = "∀-⋿⨀-⫿α-ωΑ-Ω′-‷⁺-⁾₀-₎∞±×÷→←↔⇒⇐⇔"
MATH_STRUCTURES = [
    r"[a-zA-Z]\s*[=<>≤≥≈]\s*[a-zA-Z0-9]",
    "[⁰¹²³⁴⁵⁶⁷⁸⁹ⁿ⁺⁻₀₁₂₃₄₅₆₇₈₉ₙ]",
    r"\b\d{1,3}\s*/\s*\d{1,3}\b",
    r"[a-z]\s*\(\s*[a-z]\s*\)",
    r"\bsum\b|\bprod\b|\blim\b",
    r"\b(?:sin|cos|tan|cot|sec|csc|arcsin|arccos|arctan|sinh|cosh|tanh|log|ln|exp|det|dim|ker|min|max|sup|inf|arg|sgn|diag|tr|rank)\s*[(\[]",
    r"[a-zA-Z)}\]]\s*\^\s*(?:\{[^}]+\}|\d+|[a-zA-Z])",
    r"[a-zA-Z)}\]]\s*_\s*(?:\{[^}]+\}|\d+|[a-zA-Z])",
    r"\b[a-zA-Z]\s*/\s*[a-zA-Z]\b",
    r"\|\|[^|]+\|\|",
]
MATH_STRUCTURE = "|".join(MATH_STRUCTURES)
#: Unicode mathematics and its LaTeX command, replaced in this order.
LATEX = {
    "α": r"\alpha",
    "β": r"\beta",
    "γ": r"\gamma",
    "δ": r"\delta",
    "ε": r"\epsilon",
    "ζ": r"\zeta",
    "η": r"\eta",
    "θ": r"\theta",
    "ι": r"\iota",
    "κ": r"\kappa",
    "λ": r"\lambda",
    "μ": r"\mu",
    "ν": r"\nu",
    "ξ": r"\xi",
    "π": r"\pi",
    "ρ": r"\rho",
    "σ": r"\sigma",
    "τ": r"\tau",
    "υ": r"\upsilon",
    "φ": r"\phi",
    "χ": r"\chi",
    "ψ": r"\psi",
    "ω": r"\omega",
    "Γ": r"\Gamma",
    "Δ": r"\Delta",
    "Θ": r"\Theta",
    "Λ": r"\Lambda",
    "Ξ": r"\Xi",
    "Π": r"\Pi",
    "Σ": r"\Sigma",
    "Φ": r"\Phi",
    "Ψ": r"\Psi",
    "Ω": r"\Omega",
    "≤": r"\leq",
    "≥": r"\geq",
    "≠": r"\neq",
    "≈": r"\approx",
    "≡": r"\equiv",
    "∝": r"\propto",
    "≪": r"\ll",
    "≫": r"\gg",
    "≺": r"\prec",
    "≻": r"\succ",
    "∈": r"\in",
    "∉": r"\notin",
    "⊂": r"\subset",
    "⊃": r"\supset",
    "⊆": r"\subseteq",
    "⊇": r"\supseteq",
    "∪": r"\cup",
    "∩": r"\cap",
    "∅": r"\emptyset",
    "∑": r"\sum",
    "∫": r"\int",
    "∏": r"\prod",
    "∮": r"\oint",
    "√": r"\sqrt",
    "∞": r"\infty",
    "∂": r"\partial",
    "∇": r"\nabla",
    "±": r"\pm",
    "∓": r"\mp",
    "×": r"\times",
    "÷": r"\div",
    "·": r"\cdot",
    "→": r"\to",
    "←": r"\leftarrow",
    "↔": r"\leftrightarrow",
    "⇒": r"\Rightarrow",
    "⇐": r"\Leftarrow",
    "⇔": r"\Leftrightarrow",
    "↑": r"\uparrow",
    "↓": r"\downarrow",
    "∀": r"\forall",
    "∃": r"\exists",
    "¬": r"\neg",
    "∧": r"\land",
    "∨": r"\lor",
    "⋯": r"\cdots",
    "⋮": r"\vdots",
    "⋱": r"\ddots",
    "⁰": r"^{0}",
    "¹": r"^{1}",
    "²": r"^{2}",
    "³": r"^{3}",
    "⁴": r"^{4}",
    "⁵": r"^{5}",
    "⁶": r"^{6}",
    "⁷": r"^{7}",
    "⁸": r"^{8}",
    "⁹": r"^{9}",
    "ⁿ": r"^{n}",
    "₀": r"_{0}",
    "₁": r"_{1}",
    "₂": r"_{2}",
    "₃": r"_{3}",
    "₄": r"_{4}",
    "₅": r"_{5}",
    "₆": r"_{6}",
    "₇": r"_{7}",
    "₈": r"_{8}",
    "₉": r"_{9}",
    "ₙ": r"_{n}",
}


#: The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_white(c: Column) -> Column:
    """Trim all Unicode white space (the built-in trims U+0020 only)."""
    return F.btrim(c, F.lit(WHITE))


def suffix_hyphens(c: Column) -> Column:
    """A hyphen before each known suffix of a compound; suffixes longest first, one pass each.

    A word already after a hyphen stays; stacked suffixes gain one hyphen per pass.
    """
    ordered = sorted(HYPHEN_SUFFIXES, key=len, reverse=True)
    fixed = reduce(lambda x, s: F.regexp_replace(x, rf"(?U)(?<!-)\b([A-Za-z]+){s}\b", f"$1-{s}"), ordered, c)
    # the passes change nothing in a text without a compound that is still in one piece
    return F.when(c.rlike(rf"(?U)(?<!-)\b[A-Za-z]+(?:{'|'.join(ordered)})\b"), fixed).otherwise(c)


def sentence_spacing(c: Column) -> Column:
    """A blank after a stop before a non-word character; white space runs become one blank."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(\.)(\W)", "$1 $2"), r"(?U)\s+", " ")


def normalize_for_matching(c: Column) -> Column:
    """Lower case, ASCII punctuation to blanks, single blanks, trimmed."""
    return trim_white(F.regexp_replace(F.regexp_replace(F.lower(c), r"[!-/:-@\[-\x60{-~]", " "), r"(?U)\s+", " "))


def strip_title_number(c: Column) -> Column:
    """Without the number a title begins with."""
    return F.regexp_replace(c, r"(?U)^\d+\.?\s*", "")


def strip_first_number(c: Column) -> Column:
    """Without the first digits-and-stop anywhere in the text."""
    return F.regexp_replace(c, r"(?U)^([\s\S]*?)\d+\.", "$1")


def is_caption(c: Column) -> Column:
    return trim_white(c).rlike(CAPTION)


def contains_math(c: Column) -> Column:
    return c.rlike(f"[{MATH_CHARS}]") | c.rlike(f"(?U){MATH_STRUCTURE}")


def math_density(c: Column) -> Column:
    """0 to 1: symbols, runs of single characters, fractions and Unicode indices per character."""
    n = F.char_length(c)
    part = lambda p, k, most: F.least(F.regexp_count(c, F.lit(p)) / n * k, F.lit(most))
    total = part("[∀-⋿←-⇿⨀-⫿±×÷]", 50.0, 0.3) + part(r"(?U)(\b\w\b\s){3,}", 100.0, 0.3) + part(r"(?U)\d+\s*/\s*\d+", 100.0, 0.2) + part("[₀-₉⁰-⁹]", 100.0, 0.2)
    return F.when(n > 0, F.least(total, F.lit(1.0))).otherwise(F.lit(0.0))


def latex_to_math_tags(c: Column) -> Column:
    block = F.regexp_replace(c, r"\$\$([^$]+)\$\$", r'<math display="block">$1</math>')
    return F.regexp_replace(block, r"\$([^$]+)\$", r"<math>$1</math>")


def unicode_math_to_latex(c: Column) -> Column:
    """Unicode mathematics as LaTeX, inside math tags only."""
    parts = F.split(c, r'(?=<math(?:\s+display="block")?>)|(?<=</math>)')

    def convert(p: Column) -> Column:
        head = F.regexp_extract(p, r'^(<math(?:\s+display="block")?>)([\s\S]*)(</math>)$', 1)
        inner = F.regexp_extract(p, r'^(<math(?:\s+display="block")?>)([\s\S]*)(</math>)$', 2)
        latex = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LATEX.items(), inner)
        return F.when(p.startswith("<math") & p.endswith("</math>"), F.concat(head, latex, F.lit("</math>"))).otherwise(p)

    return F.when(c.contains("<math"), F.array_join(F.transform(parts, convert), "")).otherwise(c)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text; a shorter text is its own only one, an empty one has none."""
    n = F.char_length(c)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3))))
    return F.when(n >= 3, grams).when(n > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of the trigrams of two texts, each array built once."""
    return F.transform(F.array(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b"))), lambda s: jaccard(s["a"], s["b"]))[0]
