"""Hints applied to DataFrames: the plan's joins are rewritten, and everything above them kept.

A table hint names a side of a join by its sub-query alias (of SQL, or `df.alias`). The first join, from the top, with that
alias on a side that the rewrite allows is replaced:

* BROADCAST: a broadcast hint on that side.
* SPLIT_BROADCAST: a union of broadcast joins with disjoint parts of that side; inner joins, or left_semi on the right.
* SALT, TARGETED_SALT: the other side salted and that side repeated; inner joins.

A hint that fits nowhere changes nothing. Without table names, the operators in `operators.joins` take the sides themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import internals as I
from .hints import Broadcast, Coalesce, Hint, Rebalance, Repartition, Salt, SplitBroadcast, TargetedSalt, dedupe
from .sqltext import extract, short_hash

SALT = "__keelson_salt"
Rewrite = Callable[[SparkSession, DataFrame, DataFrame, object, str, str, list[tuple[Column, Column]]], DataFrame | None]


def _keys(spark: SparkSession, join) -> list[tuple[Column, Column]]:
    """Pairs of equal expressions, (left, right), of an equi-join."""
    out = []
    condition = join.condition()
    for part in I.conjuncts(condition.get()) if condition.isDefined() else []:
        if I.kind(part) == "EqualTo":
            a, b = part.left(), part.right()
            if I.resolves_on(a, join.left()) and I.resolves_on(b, join.right()):
                out.append((I.column(spark, a), I.column(spark, b)))
            elif I.resolves_on(b, join.left()) and I.resolves_on(a, join.right()):
                out.append((I.column(spark, b), I.column(spark, a)))
    return out


def _split(n: int) -> Rewrite:
    def run(spark, left, right, condition, how, side, keys):
        if n < 2 or not keys or not (how == "Inner" or (how == "LeftSemi" and side == "right")):
            return None
        own = [k[side == "right"] for k in keys]
        kind = "inner" if how == "Inner" else "left_semi"

        def part(i: int) -> DataFrame:
            chosen = F.pmod(F.hash(*own), F.lit(n)) == i
            if side == "right":
                return left.join(F.broadcast(right.where(chosen)), condition, kind)
            return F.broadcast(left.where(chosen)).join(right, condition, kind)

        return reduce(DataFrame.unionAll, [part(i) for i in range(n)])

    return run


def _salt(n: int, hot: Sequence[str] | None) -> Rewrite:
    def run(spark, left, right, condition, how, side, keys):
        if n < 2 or how != "Inner" or not keys or (hot is not None and (not hot or len(keys) != 1)):
            return None
        build, skewed = (right, left) if side == "right" else (left, right)

        def is_hot(key: Column) -> Column:
            return F.lit(True) if hot is None else F.coalesce(key.cast("string").isin(list(hot)), F.lit(False))

        at = side == "right"
        build_key, skewed_key = keys[0][at], keys[0][not at]
        # By values, so that a task that runs again deals alike; maps can't be hashed, and then the keys alone are.
        whole = F.struct(*[k[not at] for k in keys]) if "map<" in skewed.schema.simpleString() else F.struct("*")
        salt = F.pmod(F.xxhash64(whole), F.lit(n)).cast("int")
        spread = skewed.withColumn(f"{SALT}_s", F.when(is_hot(skewed_key), salt).otherwise(F.lit(0)))
        every = F.sequence(F.lit(0), F.lit(n - 1))
        repeated = build.withColumn(f"{SALT}_b", F.explode(F.when(is_hot(build_key), every).otherwise(F.array(F.lit(0)))))
        same = condition & (F.col(f"{SALT}_s") == F.col(f"{SALT}_b"))
        return (spread.join(repeated, same) if side == "right" else repeated.join(spread, same)).drop(f"{SALT}_s", f"{SALT}_b")

    return run


def _broadcast(spark, left, right, condition, how, side, keys):
    if condition is None:
        return None
    kind = {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "FullOuter": "full", "LeftSemi": "left_semi", "LeftAnti": "left_anti"}.get(how)
    if kind is None:
        return None
    return F.broadcast(left).join(right, condition, kind) if side == "left" else left.join(F.broadcast(right), condition, kind)


def _replace(spark: SparkSession, node, table: str, rewrite: Rewrite):
    """The plan with the first fitting join rewritten, or None."""
    if I.kind(node) == "Join":
        how = node.joinType().toString()
        for side, child in (("left", node.left()), ("right", node.right())):
            if table.lower() in I.aliases(child):
                condition = I.column(spark, node.condition().get()) if node.condition().isDefined() else None
                out = rewrite(spark, I.frame(spark, node.left()), I.frame(spark, node.right()), condition, how, side, _keys(spark, node))
                if out is not None:
                    return I.analyzed(out)
    found = I.children(node)
    for i, child in enumerate(found):
        new = _replace(spark, child, table, rewrite)
        if new is not None:
            return I.with_children(spark, node, [*found[:i], new, *found[i + 1 :]])
    return None


def _rewrite_of(hint: Hint) -> tuple[list[str], Rewrite]:
    match hint:
        case Broadcast():
            return list(hint.tables), _broadcast
        case SplitBroadcast():
            return [hint.table], _split(hint.n)
        case TargetedSalt():
            return [hint.table], _salt(hint.n, hint.keys)
        case Salt():
            return [hint.table], _salt(hint.n, None)
    raise TypeError(hint)


def apply_hints(df: DataFrame, hints: Sequence[Hint]) -> tuple[DataFrame, list[Hint]]:
    """The DataFrame with hints applied, and those that found a place."""
    spark, applied, columns = df.sparkSession, [], df.columns
    for hint in dedupe(hints):
        match hint:
            case Repartition(n):
                df = df.repartition(n)
            case Coalesce(n):
                df = df.coalesce(n)
            case Rebalance():
                df = df.hint("rebalance")
            case _:
                tables, rewrite = _rewrite_of(hint)
                hit = False
                for table in tables:
                    new = _replace(spark, I.analyzed(df), table, rewrite)
                    if new is not None:
                        df, hit = I.frame(spark, new), True
                if not hit:
                    continue
        applied.append(hint)
    return (df if df.columns == columns else df.toDF(*columns)), applied


def hinted_sql(spark: SparkSession, sql: str) -> DataFrame:
    """`spark.sql` that also understands SPLIT_BROADCAST, SALT and TARGETED_SALT after the outer SELECT."""
    plain, hints = extract(sql)
    return apply_hints(spark.sql(plain), hints)[0]


def plan_fingerprint(df: DataFrame) -> str:
    """32 hex digits, equal for plans that differ in literals only."""
    text = I.canonical_plan(df)
    # Literals follow an operator or a bracket; ordinals of columns (none#0) follow a number sign.
    text = re.sub(r"(?<=[=<>(,\s])-?\d+(?:\.\d+)?[LDSBF]?(?=[\s,)])", "?", text)
    text = re.sub(r"(?<=[=<>] )(?!none#|cast|\()[^\s,()]+(?=[,)\s])", "?", text)
    return short_hash(text)


