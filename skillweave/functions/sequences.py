"""Running states over arrays, and the two dynamic programmes of a linear chain: best path and log-partition.

Everything is an expression inside one row: no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An array is run through in blocks of so many elements, so that what is gathered is copied block by block.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """struct(state, out): runs ``step(state, item) -> (state, output)`` over ``items`` and keeps every output.

    An aggregate that appends to its own result copies it at every element.  Here only a block's outputs are copied, and
    then the list of blocks, so the work stays nearly linear in the length.
    """

    def advance(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out_type}>").alias("out")), advance)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out")))

    count = F.ceil(F.size(items) / BLOCK).cast("int")
    blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))
    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    return F.aggregate(blocks, zero, block, lambda x: F.struct(x["state"].alias("state"), F.flatten(x["out"]).alias("out")))


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _best(scores: Column) -> Column:
    """struct(value, label) of the greatest score, the least label among equal ones."""
    return F.aggregate(
        scores,
        F.struct(F.lit(float("-inf")).alias("value"), F.lit(-1).alias("label"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.greatest(acc["value"], x).alias("value"), F.when((x > acc["value"]) | (acc["label"] < 0), acc["at"]).otherwise(acc["label"]).alias("label"), (acc["at"] + 1).alias("at")),
    )


def _columns(transitions: list[list[float]]) -> Column:
    """For each label the scores of coming to it from every label, as a literal."""
    n = len(transitions)
    return F.array(*[_numbers([transitions[i][j] for i in range(n)]) for j in range(n)])


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def viterbi(emissions: Column, transitions: list[list[float]], first: list[float] | None = None, last: list[float] | None = None) -> Column:
    """struct(score, path): the best label sequence for array<array<double>> ``emissions``, by max-product and back pointers.

    ``transitions[i][j]`` scores label j after i; ``first`` and ``last`` score the ends.  Ties go to the lesser label, from the
    end on.  Without an element, or with null emissions, the score is null and the path empty.
    """
    n = len(transitions)
    opening, closing, into = _numbers(first or [0.0] * n), _numbers(last or [0.0] * n), _columns(transitions)

    def forward(scores: Column, now: Column) -> tuple[Column, Column]:
        ways = F.transform(into, lambda column: _best(_plus(scores, column)))
        reached = let(ways, lambda ws: F.struct(F.zip_with(ws, now, lambda w, e: w["value"] + e).alias("scores"), F.transform(ws, lambda w: w["label"]).alias("back")))
        return reached["scores"], reached["back"]

    def path_of(run: Column) -> Column:
        end = _best(_plus(run["state"], closing))

        def trace(e: Column) -> Column:
            back = scan(F.reverse(run["out"]), e["label"], lambda label, row: (F.get(row, label), F.get(row, label)), "int")
            return F.struct(e["value"].alias("score"), F.reverse(F.concat(F.array(e["label"]), back["out"])).alias("path"))

        return let(end, trace)

    run = scan(F.slice(emissions, F.lit(2), F.greatest(F.size(emissions) - 1, F.lit(0))), _plus(opening, F.get(emissions, F.lit(0))), forward, "array<int>")
    empty = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("path"))
    return F.when(F.coalesce(F.size(emissions), F.lit(0)) > 0, let(run, path_of)).otherwise(empty)


def _log_sum(values: Column) -> Column:
    """log of the sum of exponentials, without overflow."""
    return let(F.array_max(values), lambda m: m + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - m))))


def log_partition(emissions: Column, transitions: list[list[float]], first: list[float] | None = None, last: list[float] | None = None) -> Column:
    """log of the summed exponentials of all label sequences' scores; null without an element."""
    n = len(transitions)
    opening, closing, into = _numbers(first or [0.0] * n), _numbers(last or [0.0] * n), _columns(transitions)
    step = lambda scores, now: F.zip_with(F.transform(into, lambda column: _log_sum(_plus(scores, column))), now, lambda s, e: s + e)
    total = F.aggregate(F.slice(emissions, F.lit(2), F.greatest(F.size(emissions) - 1, F.lit(0))), _plus(opening, F.get(emissions, F.lit(0))), step, lambda s: _log_sum(_plus(s, closing)))
    return F.when(F.coalesce(F.size(emissions), F.lit(0)) > 0, total)


def path_score(emissions: Column, labels: Column, transitions: list[list[float]], first: list[float] | None = None, last: list[float] | None = None) -> Column:
    """The score of one label sequence (array<int>) under the same model; null without an element."""
    n = len(transitions)
    opening, closing, rows = _numbers(first or [0.0] * n), _numbers(last or [0.0] * n), F.array(*[_numbers(r) for r in transitions])
    own = F.aggregate(F.zip_with(emissions, labels, lambda e, y: F.get(e, y)), F.lit(0.0), lambda s, x: s + x)
    moves = F.aggregate(F.transform(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda y, i: F.get(F.get(rows, F.get(labels, i)), y)), F.lit(0.0), lambda s, x: s + x)
    ends = F.get(opening, F.get(labels, F.lit(0))) + F.get(closing, F.get(labels, F.size(labels) - 1))
    return F.when(F.coalesce(F.size(emissions), F.lit(0)) > 0, own + moves + ends)
