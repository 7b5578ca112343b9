"""Grading of answers: plain forms in full, expressions that are equal for all values, answer tags, final answers.

What columns cannot express runs in Arrow batches; a text is graded by itself, and one that cannot be read counts as
unequal.
"""

from __future__ import annotations

import ast
import cmath
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from tracemill.functions import text as X

#: Commands and signs that LaTeX text is read as, powers that are not evaluated, and tags.
NAMED = (("\\cdot", "*"), ("\\times", "*"), ("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("√", "sqrt"), ("π", "pi"), ("∞", "inf"), ("∪", "U"), ("·", "*"), ("×", "*"))
BAD = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")
FINAL_LETTER = re.compile(r"(?i)<final_answer>\s*([ABCD])\s*</final_answer>")
THINK = re.compile(r"(?is)<think>(.*?)</think>")
TAG = re.compile(r"(?i)<answer>\s*([ABCD])\s*</answer>")
HIDDEN = re.compile(r"(?is)<answer>\s*[ABCD]\s*</answer>|</?think>|<final_answer>.*?</final_answer>")
ANY_TAG = re.compile(r"(?i)\(\s*<answer>\s*([ABCD])\s*</answer>\s*\)|<answer>\s*([ABCD])\s*</answer>")
ANY_HIDDEN = re.compile(r"(?i)\(\s*<answer>\s*[ABCD]\s*</answer>\s*\)|<answer>\s*[ABCD]\s*</answer>|</?think>|</?final_answer>")
ENDS = ".?!。！？\n"
#: What final answers of word problems are rid of, in this order.
SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
#: Words that an answer follows or goes before, in this order.
LEADS = ("answer:", "answer is", "answers are")
TRAILS = ("is answer", "is the answer", "are answers", "are the answers")
LINKS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


# --- expressions
def read_latex(text: str) -> str:
    """Plain text of LaTeX: fractions as a/b, roots as sqrt(a), named signs, no other commands."""
    text = text.replace("\\tfrac", "\\frac").replace("\\dfrac", "\\frac")
    braced = r"\{([^{}]*)\}"
    while True:
        new = re.sub(r"\\frac\s*" + braced + r"\s*" + braced, r" \1/\2", text)
        new = re.sub(r"\\sqrt\s*" + braced, r"sqrt(\1)", new)
        if new == text:
            break
        text = new
    for sign, word in NAMED:
        text = text.replace(sign, word)
    return re.sub(r"\\[a-zA-Z]+|\\.", "", text).strip()


def whole_number(text: str) -> int | None:
    """The integer that a text writes, as a float or with commas between thousands."""
    try:
        value = float(re.sub(r"(?<=\d),(?=\d\d\d(?:\D|$))", "", text))
        return round(value) if abs(value - round(value)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


def plain(text: str | None) -> str | None:
    """The plain form in full: as in functions.text, with LaTeX read and whole numbers as integers."""
    if text is None:
        return None
    inner = re.search(r"^\\text\{(.+?)\}$", text)
    text = inner.group(1) if inner else text
    for old, new in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , ")):
        text = text.replace(old, new)
    for unit in X.UNITS:
        text = re.sub(unit + r"(es)?(s)? *(\^[0-9]+)?", "", text)
    text = re.sub(r"\^ *\\circ", "", text)
    text = text[1:-1] if text[:1] == "{" and text[-1:] == "}" else text
    text = re.sub(r",\\! *", "", text)
    value = whole_number(text) if "," not in text else None
    text = text if value is None else str(value)
    text = read_latex(text) if "\\" in text else text
    text = re.sub(r"([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", text))
    text = re.sub("[ {}]", "", text).lower()
    value = whole_number(text)
    return text if value is None else str(value)


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|(sqrt|pi|sin|cos|tan|log|ln|exp|[A-Za-z])|([-+*/^()!]))")
_FUNCTIONS = {"sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "log": cmath.log, "ln": cmath.log, "exp": cmath.exp}


def _python(text: str) -> ast.Expression:
    """The text as a Python expression: products that are not written are put in, ^ is a power."""
    out, at, before = [], 0, ""
    text = text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"cannot read {text!r}")
        at = found.end()
        number, name, sign = found.groups()
        starts = number or name or sign == "("
        if starts and (before in ("number", "name", ")") or before == "function" and sign != "("):
            if before == "function":
                raise ValueError("a function needs brackets")
            out.append("*")
        if number:
            out.append(f"({number.lstrip('0') or '0'})" if "." not in number else f"({number})")
            before = "number"
        elif name:
            out.append(name)
            before = "function" if name in _FUNCTIONS else "name"
        else:
            out.append({"^": "**", "!": "?"}.get(sign, sign))
            before = ")" if sign == ")" else "sign"
    return ast.parse("".join(out), mode="eval")


def _value(node, names: dict) -> complex:
    if isinstance(node, ast.Expression):
        return _value(node.body, names)
    if isinstance(node, ast.Constant):
        return complex(node.value)
    if isinstance(node, ast.Name):
        return math.pi if node.id == "pi" else names.setdefault(node.id, names["_"](node.id))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        x = _value(node.operand, names)
        return -x if isinstance(node.op, ast.USub) else x
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1:
        return _FUNCTIONS[node.func.id](_value(node.args[0], names))
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left, names), _value(node.right, names)
        if isinstance(node.op, ast.Add):
            return a + b
        if isinstance(node.op, ast.Sub):
            return a - b
        if isinstance(node.op, ast.Mult):
            return a * b
        if isinstance(node.op, ast.Div):
            return a / b
        if isinstance(node.op, ast.Pow) and abs(b) <= 64:
            return a**b
    raise ValueError("no expression")


def equal_expressions(a: str, b: str, points: int = 5) -> bool:
    """Whether two expressions agree at some places where their letters have arbitrary values; an identity of such
    functions holds everywhere or almost nowhere."""
    try:
        if BAD.search(f"({a})-({b})"):
            return False
        left, right = _python(a), _python(b)
        for i in range(points):
            rng = np.random.default_rng(1 + i)
            spread = rng.uniform(0.3, 2.7, 128)
            names = {"_": lambda name, v=spread: v[ord(name[0]) % 128]}
            x, y = _value(left, names), _value(right, names)
            if not abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)):
                return False
        return True
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return False


def elements(text: str) -> list[str]:
    """The parts of a tuple or interval without inner brackets; else the text alone."""
    text = re.sub(r"(?<=\d),(?=\d\d\d(?:\D|$))", "", text)
    if not text:
        return []
    return [p.strip() for p in text[1:-1].split(",")] if re.fullmatch(r"[()\[\]][^()\[\]]+[()\[\]]", text, re.S) else [text]


def is_fraction(text: str) -> bool:
    return re.search(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$", text) is not None


def same_symbols(given: str | None, truth: str | None) -> bool:
    """The plain forms agree, or part by part: fractions as written, whole numbers only with whole numbers, the rest
    as expressions."""
    given, truth = plain(given), plain(truth)
    if truth is None or given is None:
        return False
    if truth == given:
        return True
    mine, theirs = elements(given), elements(truth)
    if not given or len(mine) != len(theirs) or len(theirs) > 1 and (truth[0] != given[0] or truth[-1] != given[-1]):
        return False

    def fits(t: str, g: str) -> bool:
        if is_fraction(t) and is_fraction(g):
            return t == g
        return (whole_number(t) is None) == (whole_number(g) is None) and equal_expressions(t, g)

    return all(map(fits, theirs, mine))


@F.pandas_udf(BooleanType())
def _same_symbols(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([same_symbols(g, t) for g, t in zip(given, truth)], dtype=bool)


@F.pandas_udf(StringType())
def plain_text(x: pd.Series) -> pd.Series:
    return x.map(plain, na_action="ignore")


def graded(given: Column, truth: Column) -> Column:
    """Whether an answer is right: the cheap forms first; only what they leave open is read as expressions."""
    cheap = X.same_answer(given, truth)
    known = given.isNotNull() & truth.isNotNull()
    residue = F.when(cheap.isNull() & known, truth)
    return F.coalesce(cheap, _same_symbols(given, residue), F.lit(False)) & known


# --- boxed answers
def boxed_score(text: Column, truth: Column) -> Column:
    """1 when the last box (with braces, or `\\boxed x` up to a dollar sign) has the truth's stricter form."""
    loose = F.regexp_extract(text, r"(?s)^.*\\boxed ([^$]*)", 1)
    box = F.when(text.contains("\\boxed "), loose).otherwise(F.when(X.last_box(text).isNotNull(), X.unboxed(X.last_box(text))))
    return F.coalesce((X.strict_form(box) == X.strict_form(truth)).cast("double"), F.lit(0.0))


def worded_answer(x: Column) -> Column:
    """The form of a final answer to a word problem: what follows the last =, without articles, units and markup."""
    x = F.element_at(F.split(x, "=", -1), -1)
    for old, new in (*SUBSTITUTIONS, *((r, "") for r in REMOVED)):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", "\\$$3\\$")
    for command in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, r"\\" + command + r"\{(.*?)\}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(F.regexp_replace(x, "frac([^{])(.)", "frac{$1}{$2}"), "sqrt([^{])", "sqrt{$1}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    return F.trim(F.when(x.rlike("^,*[0-9][0-9,]*$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))


def worded_score(text: Column, truth: Column, tail: int = 300) -> Column:
    """struct<score, pred>: 1 or -1 by the last `Answer: ...` line among the last characters; that tail is the rule."""
    said = F.regexp_extract_all(F.right(text, F.lit(tail)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    pred = worded_answer(F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("[INVALID]")))
    return F.struct(F.when(pred == worded_answer(truth), 1.0).otherwise(-1.0).alias("score"), pred.alias("pred"))


def found_answer(text: str) -> tuple[bool, str]:
    """(whether an answer with a digit was announced, its text): the last announcement of each kind narrows the text."""
    found = False

    def narrowed(text: str, word: str, after: bool) -> str | None:
        at = text.lower().rfind(word)
        if at < 0:
            return None
        return (text[at + len(word) :] if after else text[:at]).strip()

    for words, after in ((LEADS, True), (TRAILS, False)):
        for word in words:
            got = narrowed(text, word, after)
            text, found = (text, found) if got is None else (got, True)
    at = text.rfind("\\boxed")
    at = text.rfind("\\fbox") if at < 0 else at
    depth = 0
    for i in range(at, len(text) if at >= 0 else at):
        depth += (text[i] == "{") - (text[i] == "}")
        if text[i] == "}" and depth == 0:
            inner = text[text.index("{", at) + 1 : i].strip()
            text, found = (inner, True) if inner else (text, found)
            break
    text = text[: text.rfind(". ")].strip() if ". " in text else text
    for word in LINKS:
        got = narrowed(text, word, True)
        text, found = (text, found) if got is None else (got, True)
    return found and any(c.isdigit() for c in text), text


def near_numbers(given: str, truth: str, tolerance: float = 1e-4) -> bool:
    """Whether two numbers are close, a share also as its hundredth or hundredfold."""
    try:
        a, b = (float(x.replace(",", "").strip().rstrip("%")) / (100 if x.strip().endswith("%") else 1) for x in (given, truth))
    except ValueError:
        return False
    return any(abs(x - a) <= tolerance * max(abs(x), abs(a)) for x in (b / 100, b, b * 100))


def prime_score(text: str | None, truth: str | None) -> float:
    """1 for a right answer: by its symbols, by number (pi as itself or 3.14), or without brackets."""
    if text is None or truth is None:
        return 0.0
    given = found_answer(text)[1]
    if same_symbols(given, truth) or near_numbers(given, truth):
        return 1.0
    bare = [re.sub(r"[{}()\[\] ]", "", x) for x in (given, truth)]
    if bare[0] == bare[1]:
        return 1.0
    if "\\pi" in given or "\\pi" in truth:
        for pi in (str(math.pi), "3.14"):
            both = [read_latex(x.replace("\\pi", f"({pi})")) for x in (given, truth)]
            try:
                a, b = (abs(_value(_python(x), {"_": lambda name: float("nan")})) for x in both)
            except (ValueError, SyntaxError, ZeroDivisionError, OverflowError):
                continue
            if abs(a - b) <= 1e-4 * max(a, b):
                return 1.0
    return 0.0


@F.pandas_udf(DoubleType())
def announced_score(text: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([prime_score(x, t) for x, t in zip(text, truth)], dtype=float)


def geometry_score(text: Column, truth: Column) -> Column:
    """Nine tenths for the boxed answer, one for thinking that is closed before a box."""
    form = text.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    return 0.9 * graded(X.unboxed(X.last_box(text)), truth).cast("double") + 0.1 * form


# --- answer tags within the thinking
def tag_score(text: str | None, gold: str | None) -> tuple[float, int]:
    """(mean of right tags, weighted by how early they stand; number of tags).

    A tag's weight is 1 less the share of the thinking's visible characters before it; tags outside the thinking have
    none. Without weights all tags count alike.
    """
    text = text or ""
    final = FINAL_LETTER.search(text)
    target = final.group(1).upper() if final else (gold or "").strip()[:1].upper()
    tags = list(TAG.finditer(text))
    if not tags or target not in tuple("ABCD"):
        return 0.0, 0
    think = THINK.search(text)
    begin, end = think.span(1) if think else (0, len(text))
    seen = lambda part: len(HIDDEN.sub("", part))
    total = seen(text[begin:end])
    right = np.array([t.group(1).upper() == target for t in tags], float)
    # Visible characters before each tag, from those between neighbours.
    inside = [t for t in tags if begin <= t.start() <= end]
    edges = [begin, *[t.end() for t in inside]]
    before = np.cumsum([seen(text[a : t.start()]) for a, t in zip(edges, inside)]) if inside else np.zeros(0)
    weight = np.zeros(len(tags))
    if total > 0:
        weight[[i for i, t in enumerate(tags) if begin <= t.start() <= end]] = np.clip(1 - before / total, 0, 1)
    return float(right.mean() if weight.sum() <= 0 else (weight * right).sum() / weight.sum()), len(tags)


def sentence_tag_score(text: str | None, letter: str | None, most: int = 10) -> tuple[float, int]:
    """(sum of the weights of right tags by the number of tags; that number): of the first ten tags (the rule's bound),
    those count that stand in brackets and after the end of a sentence."""
    text = text or ""
    total = len(ANY_HIDDEN.sub("", text))
    tags = list(ANY_TAG.finditer(text))[:most] if total and letter is not None else []
    score, before, last = 0.0, 0, 0
    for tag in tags:
        before += len(ANY_HIDDEN.sub("", text[last : tag.start()]))
        last = tag.end()
        lead = text[: tag.start()].rstrip()
        ended = lead[-1:] != "" and lead[-1] in ENDS
        if tag.group(1) and ended and tag.group(1).upper() == letter:
            score += min(1.0, max(0.0, 1 - before / total))
    return (score / len(tags) if tags else 0.0), len(tags)


def _scores(rule):
    @F.pandas_udf("struct<score:double,tags:int>")
    def run(text: pd.Series, gold: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule(t, g) for t, g in zip(text, gold)], columns=["score", "tags"])

    return run


def tagged(text: Column, gold: Column) -> Column:
    return _scores(tag_score)(text, gold)


def sentence_tagged(text: Column, gold: Column) -> Column:
    return _scores(sentence_tag_score)(text, gold)
