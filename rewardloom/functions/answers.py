"""Answer rewards: exact, numeric, graded and typed comparison of a model answer with the truth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.extract import custom_answer, first_number_after, model_answer
from rewardloom.functions.text import let, normalised, py_float, strip
from rewardloom.profiles import V2, Profile

# Digits that are not decimal digits (superscripts, circled numbers, ...) but count as digits in Python.
OTHER_DIGITS = (
    "²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐"
    "⓪⓵-⓽⓿❶-❾➀-➈➊-➒\U00010a40-\U00010a43\U00010e60-\U00010e68"
    "\U00011052-\U0001105a\U0001f100-\U0001f10a"
)


def scored(condition: Column, weight: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))


def correctness(text: Column, answer: Column, p: Profile = V2) -> Column:
    return scored(model_answer(text, p) == answer, p.correctness)


def integer_answer(text: Column, p: Profile = V2) -> Column:
    return scored(is_digits(model_answer(text, p)), p.integer)


def is_digits(c: Column) -> Column:
    return c.rlike(f"^[\\p{{Nd}}{OTHER_DIGITS}]+\\z")


def is_close(a: Column, b: Column, rel: float = 1e-5) -> Column:
    """Relative closeness; equal infinities are close, NaN is close to nothing."""
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
    near = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * rel
    return F.when(finite, near).otherwise((a == b) & ~F.isnan(a))


def _whole(c: Column) -> Column:
    """Integers of any length as canonical text, so that no digit is lost."""
    clean = F.replace(strip(c), F.lit("_"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(clean, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z"), F.when(digits == "-0", "0").otherwise(digits))


def _truncated(c: Column) -> Column:
    number = py_float(c)
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, F.signum(number) * F.floor(F.abs(number)).cast("double") + 0.0)


def same_integer(a: Column, b: Column) -> Column:
    both = _whole(a).isNotNull() & _whole(b).isNotNull()
    return F.when(both, _whole(a) == _whole(b)).otherwise(_truncated(a) == _truncated(b))


def as_boolean(c: Column) -> Column:
    word = normalised(c)
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def as_percentage(c: Column) -> Column:
    return py_float(F.replace(c, F.lit("%"), F.lit(""))) / 100


PLAIN_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def as_fraction(c: Column) -> Column:
    """``a/b`` or a plain number. Text written by a model is never evaluated as code."""
    clean = strip(c)
    pattern = f"^({PLAIN_NUMBER})\\s*/\\s*({PLAIN_NUMBER})\\z"
    quotient = F.try_divide(
        F.regexp_extract(clean, pattern, 1).try_cast("double"), F.regexp_extract(clean, pattern, 2).try_cast("double")
    )
    return F.when(clean.rlike(pattern), quotient).when(
        clean.rlike(f"^{PLAIN_NUMBER}\\z"), clean.try_cast("double")
    )


# A quoted text inside a literal (kept as it is), or one character outside of any.
_LITERAL_PART = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[A-Za-z_]+|(?s:.)"""
_WORDS = {"True": "true", "False": "false", "None": "null"}


def literal_as_json(c: Column) -> Column:
    """A Python list or tuple literal as JSON text: brackets for parentheses, a bare list of items in brackets, JSON's names
    for the three constants, double quotes. Quoted texts stay as they are inside. Nothing is evaluated."""

    def written(part: Column) -> Column:
        quoted = F.substring(part, 1, 1).isin("'", '"') & (F.length(part) > 1)
        inside = F.substring(part, F.lit(2), F.length(part) - 2)
        text = F.concat(
            F.lit('"'), F.replace(F.replace(inside, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit('"')
        )
        plain = part
        for name, json in _WORDS.items():
            plain = F.when(part == name, json).otherwise(plain)
        return F.when(quoted & part.startswith("'"), text).when(quoted, part).otherwise(F.translate(plain, "()", "[]"))

    def closed(json: Column) -> Column:
        bare = ~json.rlike(r"^\s*[\[{]") | F.try_parse_json(json).isNull()
        wrapped = F.concat(F.lit("["), F.regexp_replace(json, r",\s*$", ""), F.lit("]"))
        return F.when(bare & json.contains(","), wrapped).otherwise(json)

    parts = F.regexp_extract_all(strip(c), F.lit(_LITERAL_PART), F.lit(0))
    # A comma may stand behind the last item; items without brackets are a list.
    return let(F.regexp_replace(F.array_join(F.transform(parts, written), ""), r",\s*(?=\])", ""), closed)


def same_list(a: Column, b: Column) -> Column:
    """Lists, tuples and matrices of numbers by value, anything else as normalised JSON."""
    return let(literal_as_json(a), lambda ja: let(literal_as_json(b), lambda jb: _same_json_list(ja, jb)))


def _same_json_list(ja: Column, jb: Column) -> Column:
    flat_a, flat_b = (F.from_json(j, "array<double>") for j in (ja, jb))
    grid_a, grid_b = (F.from_json(j, "array<array<double>>") for j in (ja, jb))

    def whole(flat: Column) -> Column:
        return flat.isNotNull() & ~F.exists(flat, lambda x: x.isNull())

    def whole_grid(grid: Column) -> Column:
        return grid.isNotNull() & ~F.exists(grid, lambda row: row.isNull() | F.exists(row, lambda x: x.isNull()))

    other = F.to_json(F.try_parse_json(ja)) == F.to_json(F.try_parse_json(jb))
    return (
        F.when(whole(flat_a) & whole(flat_b), flat_a == flat_b)
        .when(whole_grid(grid_a) & whole_grid(grid_b), grid_a == grid_b)
        .otherwise(other)
    )


def verified(model: Column, target: Column, answer_type: Column) -> Column:
    """1.0 when the model's answer equals the target under the rule of its answer type."""
    m, t = strip(model), strip(target)
    same_text = normalised(m) == normalised(t)
    equal = (
        F.when(answer_type == "Float", is_close(py_float(m), py_float(t)))
        .when(answer_type == "Integer", same_integer(m, t))
        .when(answer_type == "Boolean", as_boolean(m) == as_boolean(t))
        .when(answer_type == "Percentage", is_close(as_percentage(m), as_percentage(t)))
        .when(
            answer_type == "Fraction",
            F.coalesce(is_close(as_fraction(m), as_fraction(t)), F.lit(False)) | same_text,
        )
        .when(answer_type.isin("List", "Matrix"), same_list(m, t))
        .otherwise(same_text)
    )
    return F.when(m == "", 0.0).otherwise(scored(equal, 1.0))


def graded_answer(text: Column, answer: Column, p: Profile) -> Column:
    """Full marks for the same text, fewer for white space or a close ratio, a penalty otherwise."""
    guess = custom_answer(text, p)
    ratio = F.try_divide(py_float(guess), py_float(answer))
    # The steps of the scale.
    return (
        F.when(guess.isNull(), 0.0)
        .when(guess == answer, 3.0)
        .when(strip(guess) == strip(answer), 1.5)
        .when(ratio.isNull(), -0.5)
        .when(ratio.between(0.9, 1.1), 0.5)
        .when(ratio.between(0.8, 1.2), 0.25)
        .otherwise(-1.0)
    )


def numeric_equality(text: Column, answer: Column, p: Profile) -> Column:
    guess, truth = py_float(first_number_after(text, p.answer_open)), py_float(answer)
    return scored((guess == truth) & ~F.isnan(guess), p.numeric_answer)


def matches_expected(answer: Column, expected: Column) -> Column:
    return F.coalesce(normalised(answer) == normalised(expected), F.lit(False))


def near(predicted: Column, truth: Column, tolerance: float = 0.01) -> Column:
    return F.coalesce(F.abs(predicted - truth) < tolerance, F.lit(False))


def result_check(calculated: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    """Validity and error list of a calculated result; the result is data, nothing is executed."""
    a, b = py_float(calculated), py_float(expected)
    numeric = a.isNotNull() & b.isNotNull()
    equal = F.when(numeric, (F.abs(a - b) < tolerance) & ~F.isnan(a - b)).otherwise(
        strip(calculated) == strip(expected)
    )
    valid = F.coalesce(equal, F.lit(False))
    errors = F.when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("Answer mismatch")))
    return F.struct(valid.alias("is_valid"), errors.alias("errors"))
