"""References that templates and state stores make, taken from their text with regular expressions.

What source files declare is told by :mod:`mergetide.functions.scanner`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are part of the framework.
PLAIN_TAGS = ["font-face", "missing-glyph", "ng-container", "ng-template", "ng-content"]
PLAIN_BINDINGS = (
    "ngIf ngFor ngSwitch ngSwitchCase ngSwitchDefault ngClass ngStyle ngModel ngModelOptions ngTemplateOutlet ngTemplateOutletContext ngComponentOutlet "
    "class style id name value type src href alt title disabled readonly checked selected hidden required placeholder min max step pattern maxlength minlength "
    "rows cols size width height formControl formControlName formGroup formGroupName formArrayName routerLink routerLinkActive routerLinkActiveOptions "
    "queryParams fragment preserveFragment skipLocationChange replaceUrl cdkScrollable cdkDrag cdkDrop cdkDropList"
).split()
PLAIN_PIPES = "async currency date decimal i18nPlural i18nSelect json keyvalue lowercase number percent slice titlecase uppercase".split()
#: The text that counts as a reference in a template; group 1 is its name.
COMPONENT_TAG = r"(?i)<([a-z][a-z0-9]*(?:-[a-z0-9]+)+)[\s>/]"
BINDING = r"\[([a-z][a-zA-Z0-9]*)\]"
STRUCTURAL = r"\*([a-z][a-zA-Z0-9]*)"
PIPE = r"(?i)\|\s*([a-z][a-z0-9]*)"
#: The text that counts as a definition or a use in a state store; group 1 is its name.
ACTION_NAMES = [r"createAction\s*\(\s*['\"`]([^'\"`]+)['\"`]", r"type\s*=\s*['\"`](\[[^\]]+\][^'\"`]*)['\"`]"]
ACTION_IDS = [r"export\s+const\s+(\w+)\s*=\s*createAction", r"export\s+class\s+(\w+)\s+implements\s+Action"]
REDUCED = [r"on\s*\(\s*(\w+)", r"case\s+['\"`](\[[^\]]+\][^'\"`]*)['\"`]", r"case\s+\w+\.(\w+)\s*:"]
EFFECT, EFFECTS = r"ofType\s*\(\s*(\w+|['\"`][^'\"`]+['\"`])", r"ofType\s*\(([^)]+)\)"
DISPATCHED = r"dispatch\s*\(\s*(?:new\s+)?(\w+)"
SELECTOR_NAME, SELECTED = r"export\s+const\s+(select\w+|\w+Selector)\s*=", r"select\s*\(\s*(\w+)"
FEATURE = r"createFeatureSelector\s*(?:<[^>]+>)?\s*\(\s*['\"`](\w+)['\"`]\)"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def first(text: Column, pattern: str) -> Column:
    """The first match's group, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def without(names: Column, plain: list[str]) -> Column:
    return F.filter(names, lambda x: ~x.isin(*plain))


# templates


def component_tags(html: Column) -> Column:
    return F.array_distinct(without(F.transform(every(html, COMPONENT_TAG), F.lower), PLAIN_TAGS))


def directives(html: Column) -> Column:
    """Bindings that are not standard, then all structural ones, each name once."""
    return F.array_distinct(F.concat(without(every(html, BINDING), PLAIN_BINDINGS), every(html, STRUCTURAL)))


def pipes(html: Column) -> Column:
    """Names after a bar that are not standard; the second bar of ``||`` counts as well."""
    return F.array_distinct(without(every(html, PIPE), PLAIN_PIPES))


def template_refs(html: Column) -> Column:
    """``array<struct<type, name>>`` of all three kinds."""
    kinds = [("component", component_tags(html)), ("directive", directives(html)), ("pipe", pipes(html))]
    return F.concat(*[F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name"))) for kind, names in kinds])  # noqa: B023


# state store


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.concat(*[every(text, p) for p in patterns])


def action_names(text: Column) -> Column:
    return F.array_distinct(any_of(text, ACTION_NAMES))


def action_ids(text: Column) -> Column:
    return F.array_distinct(any_of(text, ACTION_IDS))


def action_refs(text: Column) -> Column:
    """What reducers, switches, effects and dispatches name; ``on(`` at the end of any word counts as well."""
    plain = lambda x: F.regexp_replace(x, r"^\s+|\s+$|['\"`]", "")
    of = F.transform(every(text, EFFECT), plain)
    many = F.flatten(F.transform(every(text, EFFECTS), lambda x: F.transform(F.split(x, ","), plain)))
    return F.array_distinct(F.concat(any_of(text, REDUCED), of, many, every(text, DISPATCHED)))


def selector_names(text: Column) -> Column:
    return F.array_distinct(every(text, SELECTOR_NAME))


def feature_name(text: Column) -> Column:
    return first(text, FEATURE)


def selector_refs(text: Column) -> Column:
    return F.array_distinct(F.filter(every(text, SELECTED), lambda x: F.startswith(x, F.lit("select")) | F.endswith(x, F.lit("Selector"))))


# what else files name


def template_url(text: Column) -> Column:
    return first(text, r"\btemplateUrl\s*:\s*['\"`]([^'\"`]*)['\"`]")


def style_urls(text: Column) -> Column:
    return F.flatten(F.transform(every(text, r"\bstyleUrls\s*:\s*\[([^\]]*)\]"), lambda x: F.regexp_extract_all(x, F.lit(r"['\"`]([^'\"`]*)['\"`]"), F.lit(1))))


def raw_imports(text: Column) -> Column:
    """Specifiers of single-line ``import ... from`` and ``export ... from``; side-effect imports are not seen."""
    return every(text, r"(?:import|export)\s+.*?from\s+['\"]([^'\"]+)['\"]")
