"""Contracts of JSON answers as data, and one checker that walks an answer as a variant value and tells each error with its path.

A contract becomes one expression over the parsed value: no schema is imposed on an answer before it is checked, and all of a table's answers are checked
in one pass without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of plain values, and what is said of a value of another kind.
KINDS = {"text": "must_be_a_nonempty_string", "boolean": "must_be_boolean", "unit": "must_be_between_0_and_1", "texts": "must_be_a_list_of_strings"}
NONE = "array<string>"


@dataclass(frozen=True)
class Value:
    kind: str  # text, boolean, unit, texts, any, or one_of
    one_of: tuple[str, ...] = ()
    error: str = ""  # of one_of


@dataclass(frozen=True)
class Items:
    """A list of objects."""

    of: Object
    alternate: str = ""  # a field whose values must change from item to item
    both: tuple[str, str, str] | None = None  # (field, comma-joined values that must all occur, error)


@dataclass(frozen=True)
class Object:
    """An object of fixed fields: those of the variant that its tag chooses, or, if none fits, what all of them allow and the first requires."""

    fields: dict[str, Value | Items]
    required: tuple[str, ...] | None = None  # all fields by default
    tag: tuple[str, ...] = ()  # fields that choose a variant
    variants: tuple[tuple[tuple[str, ...], Object], ...] = ()  # (the tag's values as JSON scalars, what else holds)
    untagged: str = ""  # error where no variant fits
    forbidden: tuple[tuple[str, str], ...] = ()  # (pattern of field names, error)
    list_names: bool = True  # whether a forbidden field's error names the fields
    always: str = ""  # error of a variant that may not be
    top: bool = False


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once, however often use names it: within lambdas Spark computes a repeated expression again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strings(*xs: Column) -> Column:
    return F.array_compact(F.array(*xs)) if xs else F.array().cast(NONE)


def _kind_of(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "^([A-Z]+)", 1)


def _text(v: Column) -> Column:
    return F.when(_kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _fits(v: Column, value: Value) -> Column:
    kind = _kind_of(v)
    if value.kind == "text":
        return F.coalesce(F.trim(_text(v)) != "", F.lit(False))
    if value.kind == "any":
        return F.lit(True)
    if value.kind == "boolean":
        return kind == "BOOLEAN"
    if value.kind == "unit":
        return kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & F.coalesce(F.try_variant_get(v, "$", "double").between(0, 1), F.lit(False))
    if value.kind == "texts":
        parts = F.try_variant_get(v, "$", "array<variant>")
        return (kind == "ARRAY") & ~F.exists(F.coalesce(parts, F.array().cast("array<variant>")), lambda x: _kind_of(x) != "STRING")
    return F.coalesce(_text(v).isin(*value.one_of), F.lit(False))


def _names(parts: Column) -> Column:
    return F.array_join(F.array_sort(parts), ",")


def _said(prefix: Column, error: str, names: Column | None = None) -> Column:
    """A path (empty at the top) and an error, with names behind it."""
    head = F.concat(F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit(":"))), F.lit(error))
    return head if names is None else F.concat(head, F.lit(":"), names)


def errors(v: Column, contract: Object, prefix: Column | None = None) -> Column:
    """The errors of a variant value against a contract, in order; an empty array for none. Null is no object."""
    prefix = F.lit("") if prefix is None else prefix
    fields = F.when(_kind_of(v) == "OBJECT", F.try_variant_get(v, "$", "map<string,variant>"))
    get = lambda f, x: F.coalesce(F.to_json(F.try_element_at(f, F.lit(x))), F.lit("null"))
    tags = lambda f: F.array(*[get(f, x) for x in contract.tag]) if contract.tag else F.array().cast(NONE)
    found = _let(fields, lambda f: _let(F.map_keys(f), lambda k: _let(tags(f), lambda t: _object_errors(f, k, t, contract, prefix))))
    return F.when(v.isNull(), F.array(_said(prefix, "must_be_an_object"))).otherwise(found)


def _object_errors(fields: Column, keys: Column, tags: Column, contract: Object, prefix: Column) -> Column:
    """The errors of an object's fields (null: no object), with their names and its tag as JSON scalars."""
    word = "top_level_fields" if contract.top else "fields"

    def names_of(required: tuple[str, ...], allowed: set[str]) -> Column:
        missing = F.filter(F.array(*[F.lit(x) for x in required]), lambda x: ~F.array_contains(keys, x)) if required else F.array().cast(NONE)
        unknown = F.filter(keys, lambda x: ~x.isin(*allowed))
        return _strings(F.when(F.size(missing) > 0, _said(prefix, f"missing_{word}", _names(missing))), F.when(F.size(unknown) > 0, _said(prefix, f"unknown_{word}", _names(unknown))))

    parts = []
    for pattern, error in contract.forbidden:
        hit = F.filter(keys, _like(pattern))
        parts.append(_strings(F.when(F.size(hit) > 0, _said(prefix, error, _names(hit)) if contract.list_names and error.endswith("fields_forbidden") else _said(prefix, error))))
    own = contract.required if contract.required is not None else tuple(contract.fields)
    if not contract.variants:
        parts.append(names_of(own, set(contract.fields)))
        more: list[tuple[Column, Object]] = []
    else:
        tag = [F.get(tags, F.lit(i)) for i in range(len(contract.tag))]
        more = [(_all(t == x for t, x in zip(tag, values)), o) for values, o in contract.variants]
        every = set(contract.fields).union(*(o.fields for _, o in more))
        chosen = F.when(F.lit(False), F.array().cast(NONE))
        for test, o in more:
            wrong = _strings(_said(prefix, o.always)) if o.always else F.array().cast(NONE)
            chosen = chosen.when(test, F.concat(wrong, names_of(own + (o.required if o.required is not None else tuple(o.fields)), set(contract.fields) | set(o.fields))))
        none = _strings(_said(prefix, contract.untagged)) if contract.untagged else F.array().cast(NONE)
        parts.append(chosen.otherwise(F.concat(none, names_of(own, every))))
    for name, rule in contract.fields.items():
        parts.append(_field(fields, name, rule, prefix))
    for test, o in more:
        inner = [_field(fields, name, rule, prefix) for name, rule in o.fields.items()]
        if inner:
            parts.append(F.when(test, F.concat(*inner)).otherwise(F.array().cast(NONE)))
    return F.when(fields.isNull(), F.array(_said(prefix, "must_be_an_object"))).otherwise(F.concat(*parts))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _field(fields: Column, name: str, rule: Value | Items, prefix: Column) -> Column:
    v, there = F.try_element_at(fields, F.lit(name)), F.array_contains(F.map_keys(fields), name)
    if isinstance(rule, Value):
        error = rule.error or f"{name}_{KINDS.get(rule.kind, '')}"
        return _strings(F.when(there & ~_fits(v, rule), _said(prefix, error)))
    items = F.when(_kind_of(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
    checked = _let(items, lambda xs: _items_errors(xs, name, rule, prefix))
    return F.when(there, checked).otherwise(F.array(_said(prefix, f"{name}_must_be_a_list")))


def _items_errors(items: Column, name: str, rule: Items, prefix: Column) -> Column:
    path = F.concat(F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("."))), F.lit(f"{name}["))
    at = lambda i: F.concat(path, i.cast("string"), F.lit("]"))
    each = F.flatten(F.transform(items, lambda x, i: errors(x, rule.of, at(i))))
    more = []
    if rule.alternate:
        said = F.transform(items, lambda x: F.try_variant_get(x, f"$.{rule.alternate}", "string"))
        same = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items) - 1, F.lit(1))), lambda i: F.get(said, i) == F.get(said, i - 1))
        more.append(F.transform(same, lambda i: F.concat(at(i), F.lit(":consecutive_values_must_alternate"))))
    if rule.both:
        field, values, error = rule.both
        said = F.transform(items, lambda x: F.try_variant_get(x, f"$.{field}", "string"))
        more.append(_strings(F.when(~_all(F.array_contains(F.array_compact(said), x) for x in values.split(",")), _said(prefix, error))))
    empty = F.array(_said(prefix, f"{name}_must_not_be_empty"))
    return F.when(items.isNull(), F.array(_said(prefix, f"{name}_must_be_a_list"))).when(F.size(items) == 0, empty).otherwise(F.concat(each, *more))


def answer_errors(raw: Column, contract: Object) -> Column:
    """The errors of an answer's text: it must be one JSON object without a fence around it, and keep the contract."""
    return _let(raw, lambda text: _let(F.try_parse_json(F.trim(text)), lambda v: _answer(text, v, contract)))


def _answer(raw: Column, v: Column, contract: Object) -> Column:
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", F.array(F.lit("response_text_is_empty")))
        .when(F.contains(raw, F.lit("```")), F.array(F.lit("markdown_fence_is_forbidden")))
        .when(v.isNull(), F.array(F.lit("response_must_be_one_exact_json_object")))
        .when(_kind_of(v) != "OBJECT", F.array(F.lit("response_root_must_be_an_object")))
        .otherwise(errors(v, contract))
    )


#: Roles of sections that teach nothing.
NON_LEARNING = ("promotion", "giveaway", "broadcast_ops", "small_talk", "off_topic", "duplicate", "other_non_learning")
_SECTION = {"start_utterance_id": Value("text"), "role": Value("one_of", ("learning", *NON_LEARNING), "unsupported_role"), "confidence": Value("unit"), "needs_review": Value("boolean")}
_LEARNING = Object({"title": Value("text"), "summary": Value("text"), "boundary_reason": Value("text")})
#: Sections of a video by their first utterances.
SEGMENTATION = Object(
    {
        "sections": Items(
            Object(
                _SECTION,
                tag=("role",),
                variants=((('"learning"',), _LEARNING), *(((f'"{r}"',), Object({})) for r in NON_LEARNING)),
                forbidden=(("(?i)^end_utterance_id$|timestamp|seconds|duration", "model_end_or_time_fields_forbidden"), ("^kind$", "model_kind_field_forbidden"), ("^reason$", "separate_reason_field_forbidden")),
            )
        ),
        "warnings": Value("texts"),
    },
    top=True,
)
_TRANSITION = Object(
    {"start_utterance_id": Value("text"), "class": Value("one_of", ("learning", "non_learning"), "unsupported_class")},
    tag=("class",),
    variants=((('"learning"',), Object({})), (('"non_learning"',), Object({"role": Value("one_of", NON_LEARNING, "non_learning_role_must_be_allowed")}))),
)
#: For each section whether it teaches, and, where it does so in part, from which utterances on.
ROLE_AUDIT = Object(
    {
        "decisions": Items(
            Object(
                {"has_learning_block": Value("boolean"), "has_non_learning_block": Value("boolean"), "confidence": Value("unit")},
                tag=("has_learning_block", "has_non_learning_block"),
                variants=(
                    (("true", "false"), Object({})),
                    (("false", "true"), Object({"non_learning_role": Value("one_of", NON_LEARNING, "non_learning_role_must_be_allowed")})),
                    (("true", "true"), Object({"transitions": Items(_TRANSITION, "class", ("class", "learning,non_learning", "mixed_transitions_must_cover_both_classes"))})),
                    (("false", "false"), Object({"non_learning_role": Value("any"), "transitions": Value("any")}, required=(), always="both_presence_flags_cannot_be_false")),
                ),
            )
        )
    },
    top=True,
)
#: Reviews of suspicious utterances.
EDITORIAL = Object(
    {
        "reviews": Items(
            Object(
                {"utterance_id": Value("text"), "decision": Value("one_of", ("keep", "repair", "unresolved"), "unsupported_decision"), "confidence": Value("one_of", ("high", "medium", "low"), "unsupported_confidence")},
                tag=("decision",),
                variants=((('"repair"',), Object({"corrected_text": Value("text"), "changes": Items(Object({"from": Value("text"), "to": Value("text"), "reason": Value("text")}))})), (('"keep"',), Object({})), (('"unresolved"',), Object({}))),
            )
        )
    },
    top=True,
)
