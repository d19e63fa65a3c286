"""JSON objects of any keys: merged, moved and cut by key, as variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(text: Column) -> Column:
    """A JSON object as map of variants; what is no object has no fields."""
    none = F.create_map().cast("map<string,variant>")
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), none)


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _once(values: tuple[Column, ...], body: Callable[..., Column]) -> Column:
    """``body`` of values that are computed once, however often the body uses them."""
    names = [f"v{i}" for i in range(len(values))]
    packed = F.struct(*(v.alias(n) for v, n in zip(values, names)))
    return F.transform(F.array(packed), lambda p: body(*(p[n] for n in names)))[0]


def _merged(old: Column, new: Column, depth: int) -> Column:
    """Maps of variants: keys of ``old`` that ``new`` doesn't have stay, those that are null in ``new`` go."""

    def of(a: Column, b: Column) -> Column:
        if not depth:
            return F.coalesce(b, a)
        inner = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.to_variant_object(_merged(x, y, depth - 1))).otherwise(F.coalesce(b, a))
        return _once((_object(a), _object(b)), inner)

    def whole(o: Column, n: Column) -> Column:
        keys = F.array_union(F.map_keys(o), F.map_keys(n))
        kept = F.filter(keys, lambda k: ~F.coalesce(F.is_variant_null(F.try_element_at(n, k)), F.lit(False)))
        return _once((kept,), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: of(F.try_element_at(o, k), F.try_element_at(n, k)))))

    return _once((old, new), whole)


def merge(old: Column, new: Column, depth: int = 0) -> Column:
    """The JSON text of ``old`` with the fields of ``new``: other keys are kept, whatever they are, nulls remove theirs, and objects in both
    are merged down to ``depth`` levels below, replaced beyond. What is no object counts as an empty one."""
    return F.to_json(_merged(fields(old), fields(new), depth))


def move(text: Column, keys: tuple[str, ...], under: str) -> Column:
    """``keys`` of an object put below the key ``under``, beside what is there; as it is if it has none of them."""

    def of(have: Column) -> Column:
        moved = F.map_filter(have, lambda k, v: k.isin(*keys))
        inner = F.coalesce(_object(F.try_element_at(have, F.lit(under))), fields(F.lit("{}")))
        rest = F.map_filter(have, lambda k, v: ~k.isin(*keys, under))
        whole = F.map_concat(rest, F.create_map(F.lit(under), F.to_variant_object(_merged(inner, moved, 0))))
        return F.when(F.size(moved) > 0, whole).otherwise(have)

    return F.to_json(_once((fields(text),), of))


def without(text: Column, keys: tuple[str, ...]) -> Column:
    return F.to_json(F.map_filter(fields(text), lambda k, v: ~k.isin(*keys)))
