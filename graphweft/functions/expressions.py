"""Column expressions: identifiers, names, paths, versions and the ordered lookups. None of them leaves the JVM."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of selectors, in order, with the package that has them.
SELECTOR_PACKAGES = [
    ("p-", "primeng"), ("mat-", "@angular/material"), ("mdc-", "@angular/material"), ("nz-", "ng-zorro-antd"),
    ("nb-", "@nebular/theme"), ("ion-", "@ionic/angular"), ("igx-", "igniteui-angular"), ("ng-", "ng-*"),
    ("dx-", "devextreme-angular"), ("kendo-", "@progress/kendo-angular"), ("po-", "@po-ui/ng-components"),
]
#: What a class under test may be called after its name.
CLASS_SUFFIXES = ["Component", "Service", "Directive", "Pipe", "Module", "Guard", "Resolver", "Interceptor"]
#: Categories of projects by tag.
TAG_CATEGORIES = [("type:feature", "feature"), ("type:domain", "domain"), ("type:shared", "shared"), ("type:util", "utility"), ("type:utility", "utility")]


def stable_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16)


def database_name(name: Column, path: Column) -> Column:
    """A safe database name: lower case, other characters as _, leading non-letters gone, 40 characters and a hash."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_"), "^[^a-z]+", "")
    safe = F.substring(safe, 1, 40)
    return F.concat(F.when(safe == "", "app").otherwise(safe), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))


def pascal_case(name: Column) -> Column:
    parts = F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def class_suffix(name: Column) -> Column:
    return reduce(lambda a, s: a.when(F.endswith(name, F.lit(s)), s), CLASS_SUFFIXES, F.when(F.lit(False), F.lit("")))


def folded_path(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def selector_package(selector: Column) -> Column:
    first, *rest = SELECTOR_PACKAGES
    chain = reduce(lambda a, p: a.when(F.startswith(selector, F.lit(p[0])), p[1]), rest, F.when(F.startswith(selector, F.lit(first[0])), first[1]))
    return chain.otherwise("unknown")


def scope(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".spec.")), "test").otherwise("production")


def version(text: Column) -> Column:
    """The first x, x.y or x.y.z of a range as three numbers; null where there is none."""
    found = F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", 0)
    part = lambda k: F.coalesce(F.try_element_at(F.split(found, r"\."), F.lit(k)).cast("int"), F.lit(0))
    return F.when(found != "", F.array(part(1), part(2), part(3)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def priority(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "p1").when(severity == "medium", "p2").otherwise("p3")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def tag_category(tags: Column) -> Column:
    return reduce(lambda a, t: a.when(F.array_contains(tags, t[0]), t[1]), TAG_CATEGORIES, F.when(F.lit(False), F.lit("")))


def cursor(skip: int) -> str:
    return base64.b64encode(json.dumps({"skip": skip}).encode()).decode()


def skip_of(text: str | None) -> int:
    """0 for none, for anything unreadable and for negative numbers."""
    try:
        return max(0, int(json.loads(base64.b64decode(text))["skip"])) if text else 0
    except (ValueError, KeyError, TypeError):
        return 0
