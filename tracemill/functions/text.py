"""Text functions on columns: answer boxes, canonical forms, letters, reasoning spans, prefixes."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters and commands that canonical forms drop or replace, units, and letter patterns.
DASHES = (("–", "-"), ("−", "-"))
SPACING = ("\\,", "\\;", "\\!", "\\left", "\\right")
FRACTIONS = (("tfrac", "frac"), ("dfrac", "frac"))
DEGREES = ("^{\\circ}", "^\\circ")
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard")
STRONG = r"(?i)(?:^|\b(?:answer|ans)\s*[:\-]?\s*)([ABCD])(?:\s*[:.)]|\s|$)"
SOFT = r"(?i)(?<![A-Za-z])([ABCD])(?![A-Za-z])"
FINAL = r"(?is)<final_answer>(.*?)</final_answer>"


#: Prompts, by name, with the columns that go into them.
PROMPTS = {
    "choice": "**Question**:\n{question}\n**Choices**:\nA: {a}\nB: {b}\nC: {c}\nD: {d}\nNow based on the above reasoning, you must give the correct option in the form <final_answer>your answer(A,B,C,D,only one letter)</final_answer>. You must give an option.",
    "math": "Here is a math problem:\n{problem}\n\nPlease provide detailed reasoning inside <think>...</think> and then output your final answer inside \\boxed{{}}",
    "open probe": "<think> {prefix} <stop> </think>\n$$\n\\boxed{{",
    "closed probe": "<think> {prefix} </think><final_answer>",
}


def prompt(name: str, **columns: Column) -> Column:
    """The named prompt with columns put in."""
    parts = [F.lit(x) if field is None else piece for text, field, _, _ in string.Formatter().parse(PROMPTS[name]) for x, field, piece in ((text, None, None), (None, field, columns.get(field))) if x or field]
    return F.concat(*parts)


def opened(system: Column, user: Column, thought: Column | None = None) -> Column:
    """A conversation opened for thinking, or with the thinking given and closed."""
    head = [F.lit("<system>"), system, F.lit("</system>\nuser\n"), user, F.lit("\nassistant\n<think> ")]
    return F.concat(*head) if thought is None else F.concat(*head, thought, F.lit(" </think>\n"))


#: How models mark calls of tools, in the order in which texts are tried.
CALL_MARKS = (r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", r"(?s)\[TOOL_CALLS\]\s*(\[.*\])", r"(?s)<\|python_tag\|>\s*(\{.*\})")
CALL = "struct<name:string,arguments:string,parameters:string>"


def tool_calls(text: Column) -> Column:
    """struct<calls: array<struct<name, arguments>>, content>: calls in JSON after any of the marks, and the text before
    the first one. Calls that are no JSON or have no name are left out."""
    tagged, listed, bare = (F.regexp_extract_all(text, F.lit(m), F.lit(1)) for m in CALL_MARKS)
    one = lambda j: F.from_json(j, CALL)
    many = F.flatten(F.transform(listed, lambda j: F.coalesce(F.from_json(j, f"array<{CALL}>"), F.array().cast(f"array<{CALL}>"))))
    found = F.when(F.size(tagged) > 0, F.transform(tagged, one)).when(F.size(listed) > 0, many).otherwise(F.transform(bare, one))
    calls = F.transform(F.filter(found, lambda c: c["name"].isNotNull()), lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["arguments"], c["parameters"], F.lit("{}")).alias("arguments")))
    return F.struct(calls.alias("calls"), F.regexp_extract(text, r"(?s)^(.*?)(?:<tool_call>|\[TOOL_CALLS\]|<\|python_tag\|>|\z)", 1).alias("content"))


def let(x: Column, f) -> Column:
    """f(x) with x computed once: a column that a branch repeats would be expanded each time."""
    return F.transform(F.array(x), lambda v: f(v))[0]


def _replaced(x: Column, pairs) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def last_box(text: Column, command: str = "boxed") -> Column:
    """The last \\boxed{...} with balanced braces, null if there is none or it stays open.

    The tail from the command on is walked once, counting depth; what comes after the closing brace is not seen.
    """
    tail = F.regexp_extract(text, rf"(?s)^.*(\\{command}\s*\{{.*)$", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        at = acc["at"] + 1
        end = F.when((acc["end"] == 0) & (c == "}") & (depth == 0), at).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step, lambda acc: acc["end"])
    return F.when((tail != "") & (end > 0), F.substring(tail, F.lit(1), end))


def boxed_or_framed(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\boxed")), last_box(text)).otherwise(last_box(text, "fbox"))


def unboxed(box: Column) -> Column:
    """Content of \\boxed{...}; empty where there is none."""
    return F.coalesce(F.when(F.startswith(box, F.lit("\\boxed")), F.regexp_extract(box, r"(?s)^\\boxed\s*\{(.*)\}$", 1)), F.lit(""))


def answer_key(text: Column) -> Column:
    """Box, else <final_answer>, else the trimmed text."""
    box, final = F.nullif(unboxed(last_box(text)), F.lit("")), F.nullif(F.trim(F.regexp_extract(text, FINAL, 1)), F.lit(""))
    return F.coalesce(box, final, F.trim(text))


def canonical(x: Column) -> Column:
    """A light canonical form for cheap equality."""
    x = _replaced(F.trim(x), DASHES)
    x = _replaced(x, [(s, "") for s in SPACING])
    x = F.regexp_replace(x, r"\\text\{([^}]*)\}", "$1")
    x = _replaced(x, FRACTIONS)
    x = _replaced(x, [(d, "") for d in DEGREES])
    return F.btrim(F.replace(x, F.lit(" "), F.lit("")), F.lit("$"))


def math_form(x: Column) -> Column:
    """A stricter form: braces around one-character arguments of \\frac and \\sqrt, a/b as \\frac, no units."""
    return strict_form(F.trim(F.regexp_replace(F.trim(x), r"^\\text\{(.+?)\}$", "$1")))


def strict_form(x: Column) -> Column:
    """The steps of math_form on a text as it is."""
    x = _replaced(x, [("\n", ""), ("\\!", ""), ("\\\\", "\\"), *FRACTIONS, ("\\left", ""), ("\\right", ""), *[(d, "") for d in DEGREES], ("\\$", "")])
    x = F.split(x, r"\\text\{ ", -1)[0]
    x = _replaced(x, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    x = F.regexp_replace(F.regexp_replace(x, r"^\.", "0."), r"^[^=]{0,2}=([^=]*)$", "$1")
    x = F.regexp_replace(x, r"\\sqrt([^{])", "\\\\sqrt{$1}")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.regexp_replace(x, r"\\frac([^{])([^{])", "\\\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{])\{", "\\\\frac{$1}{")
    x = F.regexp_replace(x, r"^0\.5$", "\\\\frac{1}{2}")
    return F.regexp_replace(x, r"^(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))$", "\\\\frac{$1}{$2}")


def plain_form(x: Column) -> Column:
    """Lower-case text without units, signs of currency and share, braces and blanks; whole numbers as integers."""
    x = F.regexp_replace(x, r"^\\text\{(.+?)\}$", "$1")
    x = _replaced(x, [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , ")])
    for unit in UNITS:
        x = F.regexp_replace(x, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    x = F.regexp_replace(x, r"(?s)^\{(.*)\}$", "$1")
    x = F.regexp_replace(x, r",\\! *", "")
    x = F.regexp_replace(x, r"^([0-9]+)\.0+$", "$1")
    x = F.regexp_replace(F.regexp_replace(x, "- *", "-"), r"([0-9]) +([0-9])", "$1+$2")
    return F.lower(F.regexp_replace(x, r"[ {}]", ""))


def without_digit_commas(x: Column) -> Column:
    """1,234,567 -> 1234567; commas between other things stay."""
    return F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "")


def tuple_parts(x: Column) -> Column:
    inner = F.regexp_extract(x, r"^[(\[]([^()\[\]]+)[)\]]$", 1)
    return F.when(x == "", F.array().cast("array<string>")).when(inner != "", F.transform(F.split(inner, ","), lambda p: F.trim(p))).otherwise(F.array(x))


def is_fraction(x: Column) -> Column:
    return x.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def is_whole(x: Column) -> Column:
    """Whether a text writes a whole number, with commas between thousands or a zero fraction."""
    number = without_digit_commas(x).try_cast("double")
    return F.coalesce(F.abs(number - F.round(number)) <= 1e-7, F.lit(False))


def mixed_number(x: Column) -> Column:
    """3 1/2 -> 3+1/2."""
    return F.regexp_replace(x, r"([0-9]) +([0-9])", "$1+$2")


def same_answer(given: Column, truth: Column) -> Column:
    """Cheap equality, then the math form, then the plain form; null when all fail (a symbolic check may decide)."""
    plain = let(plain_form(truth), lambda t: (t != "") & (plain_form(given) == t))
    return F.when(canonical(given) == canonical(truth), True).when(math_form(given) == math_form(truth), True).when(plain, True)


def letter(text: Column) -> Column:
    """A to D from the final answer's text, or all of it: the strong pattern, else the first letter by itself."""
    part = F.regexp_extract(text, FINAL, 1)
    part = F.when(text.rlike(FINAL), part).otherwise(text)
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(part, STRONG, 1), F.lit("")), F.nullif(F.regexp_extract(part, SOFT, 1), F.lit(""))))


def gold_letter(x: Column) -> Column:
    """0 to 3 as a letter, else the first letter A to D."""
    by_number = F.translate(F.when(x.rlike("^[0-3]$"), x), "0123", "ABCD")
    return F.coalesce(by_number, F.upper(F.nullif(F.regexp_extract(x, "([A-Da-d])", 1), F.lit(""))))


def cleaned_thinking(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)<final_answer>.*?</final_answer>", "")
    return F.trim(F.regexp_replace(x, r"(?i)</?(?:final_answer|think)>", ""))


def thinking(text: Column) -> Column:
    """Text between <think> and </think>, or to the end."""
    return F.regexp_extract(text, r"(?is)<think>(.*?)(?:</think>|\z)", 1)


def reasoning_and_content(text: Column, strict: bool) -> Column:
    """struct<reasoning, content>; strict: both tags are needed, else all is content; otherwise a missing end means
    all is reasoning."""
    opened, closed = F.locate("<think>", text), F.locate("</think>", text)
    body = F.replace(F.substring(text, F.lit(1), closed - 1), F.lit("<think>"), F.lit(""))
    rest = F.substring(text, closed + 8, F.length(text))
    none = F.lit(None).cast("string")
    lost = F.struct(none.alias("reasoning"), text.alias("content")) if strict else F.struct(F.replace(text, F.lit("<think>"), F.lit("")).alias("reasoning"), none.alias("content"))
    needed = (opened > 0) & (closed > opened) if strict else closed > 0
    return F.when(needed, F.struct(body.alias("reasoning"), F.nullif(rest, F.lit("")).alias("content"))).otherwise(lost)


def stops(text: Column, mark: str = "<stop>") -> Column:
    return F.filter(F.transform(F.split(text, mark, -1), lambda p: F.trim(p)), lambda p: p != "")


def prefix_rows(df: DataFrame, parts: str, joint: str = " <stop> ") -> DataFrame:
    """A row (k, prefix) for the first k parts, joined, for every k; no row holds more than one prefix."""
    rows = df.filter(F.size(parts) > 0).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.size(parts).cast("long"))))
    return rows.withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("k").cast("int")), joint)).drop(parts)


def last_parts(parts: Column, n: int, joint: str = " <stop> ") -> Column:
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), joint)


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^.!?。！？]+[.!?。！？]*"), F.lit(0))


def thought_steps(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"->|[.!?\n]"), lambda p: F.trim(p)), lambda p: p != "")


def cut_at_stop(text: Column, marks: list[str], keep: bool) -> Column:
    """Text up to the first of the marks, in list order, that occurs."""
    out = text
    for mark in reversed(marks):
        at = F.locate(mark, text)
        out = F.when(at > 0, F.substring(text, F.lit(1), at - 1 + (len(mark) if keep else 0))).otherwise(out)
    return out


def foreign_letters(text: Column) -> Column:
    return text.rlike(r"[\p{L}&&[^A-Za-z]]")


def wide_gap(text: Column) -> Column:
    return text.rlike(" {10,}")


def length_match(steps: Column, length: Column, coefficient: Column) -> Column:
    """1 on the right side of length x coefficient, a ratio in [0, 1] beyond it."""
    target = length * coefficient
    short = coefficient < 0.5
    none = F.when(short & (steps > 0), 0.0).otherwise(1.0)
    some = F.when(short, F.when(steps <= target, 1.0).otherwise(target / steps)).otherwise(F.when(steps >= target, 1.0).otherwise(steps / target))
    return F.when(target <= 0, none).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), some)))


def close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
