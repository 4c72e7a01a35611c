"""Comparison of two programs' steps as native folds: strict, position by position, and relaxed, along a longest common subsequence of actions.

Steps are what ``programs.parse_program`` gives: structs of action, output and arguments by key, an argument being (kind, value).  The strict comparison carries which
predicted variable stands for which gold one; a pair is added only after a step without an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from protomill.functions.text import let

_DETAIL = "array<struct<step:int,gold_action:string,pred_action:string,errors:array<string>>>"
_SHARE = "array<struct<step:int,gold_action:string,pred_action:string,status:string,matched:int,total:int>>"


def _empty_if_null(steps: Column) -> Column:
    return F.coalesce(steps, F.filter(steps, lambda s: F.lit(False)), F.array().cast("array<struct<action:string,output:string,inputs:map<string,struct<kind:string,value:string>>>>"))


def _kind(argument: Column, at: Column, outputs: Column, raw: Column) -> Column:
    """What an argument of the step at a place refers to; the last assignment of a name counts."""
    back = F.array_position(F.reverse(outputs), argument["value"])
    made = F.size(outputs) - back
    name = F.when(back > 0, F.when(made < at, "generated_var").otherwise("future_generated_var")).otherwise(F.when(F.array_contains(raw, argument["value"]), "raw_var").otherwise("unknown_var"))
    return F.when(argument["kind"] == "name", name).otherwise(argument["kind"])


def _number(value: Column) -> Column:
    return F.when(value == "True", F.lit(1.0)).when(value == "False", F.lit(0.0)).otherwise(value.try_cast("double"))


def _equal(kind: Column, a: Column, b: Column) -> Column:
    """Literals are equal by value, everything else by name."""
    return (a == b) | ((kind == "literal") & F.coalesce(_number(a) == _number(b), F.lit(False)))


def _near(a: Column, b: Column) -> Column:
    """Equal literals, or numbers within a tenth of the larger; booleans only if equal."""
    flag = a.isin("True", "False") | b.isin("True", "False")
    x, y = _number(a), _number(b)
    close = F.abs(x - y) <= F.greatest(0.1 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-6))
    return (a == b) | F.coalesce(F.when(flag, x == y).otherwise(close), F.lit(False))


def _with(map_: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(map_, lambda k, v: k != key), F.create_map(key, value))


def _keys(step: Column) -> Column:
    return F.array_sort(F.map_keys(step["inputs"]))


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)^'(.*)'$", "$1")


def strict_details(gold: Column, pred: Column, raw: Column) -> Column:
    """array<struct<step, gold_action, pred_action, errors>>, a row for each place of the longer program; a step is right if it has no errors."""
    made = lambda steps: F.transform(steps, lambda s: s["output"])
    both = F.least(F.size(gold), F.size(pred))
    start = F.struct(F.create_map().cast("map<string,string>").alias("same"), F.array().cast(_DETAIL).alias("rows"))

    def step(state: Column, pair: Column) -> Column:
        i, g, p = pair["i"], pair["g"], pair["p"]

        def error(key: Column) -> Column:
            a, b = F.try_element_at(g["inputs"], key), F.try_element_at(p["inputs"], key)
            ka, kb = _kind(a, i, made(gold), raw), _kind(b, i, made(pred), raw)
            meant = F.try_element_at(state["same"], b["value"])
            told = lambda *parts: F.concat(key, *[x if isinstance(x, Column) else F.lit(x) for x in parts])
            return (
                F.when(ka != kb, told(":type:", ka, "!=", kb))
                .when(ka == "generated_var", F.when(~F.coalesce(meant == a["value"], F.lit(False)), told(":generated_ref:", a["value"], "!=", F.coalesce(meant, b["value"]))))
                .when(~_equal(ka, a["value"], b["value"]), told(":value:", _plain(a["value"]), "!=", _plain(b["value"])))
            )

        errors = (
            F.when(g["action"] != p["action"], F.array(F.lit("action_mismatch")))
            .when(_keys(g) != _keys(p), F.array(F.lit("parameter_keys_mismatch")))
            .when(g["output"].isNull() != p["output"].isNull(), F.array(F.lit("output_assignment_mismatch")))
            .otherwise(F.array_compact(F.transform(_keys(g), error)))
        )

        def after(found: Column) -> Column:
            clean = (F.size(found) == 0) & g["output"].isNotNull() & p["output"].isNotNull()
            same = F.when(clean, _with(state["same"], F.coalesce(p["output"], F.lit("")), g["output"])).otherwise(state["same"])
            row = F.struct((i + 1).alias("step"), g["action"].alias("gold_action"), p["action"].alias("pred_action"), found.alias("errors"))
            return F.struct(same.alias("same"), F.array_append(state["rows"], row).alias("rows"))

        return let(errors, after)

    pairs = F.zip_with(F.slice(gold, F.lit(1), both), F.slice(pred, F.lit(1), both), lambda g, p: F.struct(g.alias("g"), p.alias("p")))
    placed = F.transform(pairs, lambda x, i: F.struct(i.alias("i"), x["g"].alias("g"), x["p"].alias("p")))
    rest = lambda steps, name, word: F.transform(
        F.slice(steps, both + 1, F.size(steps)),
        lambda s, i: F.struct((both + i + 1).alias("step"), *[(s["action"] if n == name else F.lit(None).cast("string")).alias(n) for n in ("gold_action", "pred_action")], F.array(F.lit(word)).alias("errors")),
    )
    return F.concat(F.aggregate(placed, start, step, lambda s: s["rows"]), rest(gold, "gold_action", "missing_step"), rest(pred, "pred_action", "extra_step"))


def alignment(gold: Column, pred: Column) -> Column:
    """array<struct<i, j>>: a longest common subsequence of two arrays of actions; among equals the gold index advances first."""
    zeros = F.transform(F.sequence(F.lit(0), F.size(pred)), lambda _: F.lit(0))

    def row(below: Column, action: Column) -> Column:
        """Lengths from each place of ``pred`` on, from those of one gold action less; built from the end."""
        step = lambda done, j: F.array_append(done, F.when(F.get(pred, j) == action, F.get(below, j + 1) + 1).otherwise(F.greatest(F.get(below, j), F.element_at(done, -1))))
        places = F.when(F.size(pred) > 0, F.sequence(F.size(pred) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.reverse(F.aggregate(places, F.array(F.lit(0)), step))

    table = F.aggregate(F.reverse(gold), F.array(zeros), lambda rows, a: F.array_append(rows, row(F.element_at(rows, -1), a)))

    def walk(rows: Column) -> Column:
        """``rows``: the table, from the end of gold."""
        best = lambda i, j: F.get(F.get(rows, F.size(gold) - i), j)

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]
            inside = (i < F.size(gold)) & (j < F.size(pred))
            equal = inside & (F.get(gold, i) == F.get(pred, j))
            gold_moves = inside & ~equal & (best(i + 1, j) >= best(i, j + 1))
            return F.struct(
                (i + F.when(equal | gold_moves, 1).otherwise(0)).alias("i"),
                (j + F.when(equal | (inside & ~gold_moves), 1).otherwise(0)).alias("j"),
                F.when(equal, F.array_append(s["pairs"], F.struct(i.alias("i"), j.alias("j")))).otherwise(s["pairs"]).alias("pairs"),
            )

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"))
        return F.aggregate(F.sequence(F.lit(0), F.size(gold) + F.size(pred)), start, step, lambda s: s["pairs"])

    return let(table, walk)


def relaxed_details(gold: Column, pred: Column, raw: Column, pairs: Column) -> Column:
    """array<struct<step, gold_action, pred_action, status, matched, total>>: gold steps, aligned or missing, then extra predicted ones; every key of either side counts."""
    made = lambda steps: F.transform(steps, lambda s: s["output"])
    named = F.filter(F.transform(pairs, lambda x: F.struct(F.get(gold, x["i"])["output"].alias("g"), F.get(pred, x["j"])["output"].alias("p"))), lambda x: x["g"].isNotNull() & x["p"].isNotNull())
    meant = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, x: _with(m, x["p"], x["g"]))

    def rows(meant: Column) -> Column:
        def own(g: Column, i: Column) -> Column:
            j = F.get(F.filter(pairs, lambda x: x["i"] == i), 0)["j"]
            p = F.get(pred, j)

            def right(key: Column) -> Column:
                a, b = F.try_element_at(g["inputs"], key), F.try_element_at(p["inputs"], key)
                kind = _kind(a, i, made(gold), raw)
                fits = F.when(kind == "generated_var", F.coalesce(F.try_element_at(meant, b["value"]) == a["value"], F.lit(False))).when(kind == "literal", _near(a["value"], b["value"])).otherwise(a["value"] == b["value"])
                return (kind == _kind(b, j, made(pred), raw)) & fits

            matched = F.size(F.filter(F.array_intersect(F.map_keys(g["inputs"]), F.map_keys(p["inputs"])), right))
            there = j.isNotNull()
            total = F.when(there, F.size(F.array_union(F.map_keys(g["inputs"]), F.map_keys(p["inputs"])))).otherwise(F.size(F.map_keys(g["inputs"])))
            return F.struct((i + 1).alias("step"), g["action"].alias("gold_action"), p["action"].alias("pred_action"), F.when(there, "aligned").otherwise("missing_step").alias("status"), F.when(there, matched).otherwise(0).alias("matched"), total.alias("total"))

        other = lambda p, j: F.when(
            ~F.exists(pairs, lambda x: x["j"] == j),
            F.struct((j + 1).alias("step"), F.lit(None).cast("string").alias("gold_action"), p["action"].alias("pred_action"), F.lit("extra_step").alias("status"), F.lit(0).alias("matched"), F.size(F.map_keys(p["inputs"])).alias("total")),
        )
        return F.concat(F.transform(gold, own).cast(_SHARE), F.array_compact(F.transform(pred, other)).cast(_SHARE))

    return let(meant, rows)


def order_similarity(gold: Column, pred: Column) -> Column:
    """One less the share of inverted pairs of two short arrays of actions; zero unless both hold the same actions equally often."""
    turn = lambda xs, a, i: F.size(F.filter(F.slice(xs, F.lit(1), i + 1), lambda x: x == a))
    places = lambda a: F.filter(F.transform(pred, lambda x, j: F.when(x == a, j)), lambda j: j.isNotNull())
    ranks = F.transform(gold, lambda a, i: F.get(places(a), turn(gold, a, i) - 1))
    inverted = lambda rs: F.aggregate(F.transform(rs, lambda r, i: F.size(F.filter(F.slice(rs, F.lit(1), i), lambda x: x > r))), F.lit(0), lambda s, x: s + x)
    n = F.size(gold)
    return F.when(F.array_sort(gold) != F.array_sort(pred), 0.0).when(n <= 1, 1.0).otherwise(1 - let(ranks, inverted) / (n * (n - 1) / 2))


def scores(gold: Column, pred: Column, raw: Column) -> Column:
    """All twelve results of comparing two programs' steps, null steps being none: six scores, four counts, and the details of both comparisons."""

    def told(x: Column) -> Column:
        g, p, ga, pa = x["g"], x["p"], x["ga"], x["pa"]
        longest = F.greatest(F.size(ga), F.size(pa), F.lit(1))
        positional = F.size(F.filter(F.zip_with(ga, pa, lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))) / longest
        return let(
            F.struct(strict_details(g, p, raw).alias("d"), x["pairs"].alias("pairs"), relaxed_details(g, p, raw, x["pairs"]).alias("r"), order_similarity(ga, pa).alias("order"), positional.alias("positional"), longest.alias("longest")),
            finish,
        )

    def finish(y: Column) -> Column:
        count = lambda c: F.aggregate(y["r"], F.lit(0), lambda s, r: s + r[c])
        errors = F.size(F.filter(y["d"], lambda r: F.size(r["errors"]) > 0))
        strict = F.greatest(F.lit(0.0), 1 - errors / y["longest"])
        relaxed = count("matched") / F.greatest(count("total"), F.lit(1))
        return F.struct(
            y["order"].alias("sequence"), strict.alias("parameters"), ((y["order"] + strict) / 2).alias("final"), y["positional"].alias("relaxed_sequence"), relaxed.alias("relaxed_parameters"),
            ((y["positional"] + relaxed) / 2).alias("relaxed_final"), errors.alias("errors"), F.size(y["pairs"]).alias("aligned"), count("matched").alias("matched"), count("total").alias("total"),
            y["d"].alias("details"), y["r"].alias("relaxed_details"),
        )

    actions = lambda steps: F.transform(steps, lambda s: s["action"])
    steps = F.struct(_empty_if_null(gold).alias("g"), _empty_if_null(pred).alias("p"))
    named = lambda s: F.struct(s["g"].alias("g"), s["p"].alias("p"), actions(s["g"]).alias("ga"), actions(s["p"]).alias("pa"))
    paired = lambda s: F.struct(*[s[c].alias(c) for c in ("g", "p", "ga", "pa")], alignment(s["ga"], s["pa"]).alias("pairs"))
    return reduce(let, (named, paired, told), steps)
