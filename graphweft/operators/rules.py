"""The rules that findings follow, as rows; extended by adding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Reason code, confidence, severity, category.
REASONS = [
    ("ANG_NGMODULE_HEAVY", 0.95, "medium", "angular"), ("ANG_ENTRY_COMPONENTS", 0.90, "high", "angular"),
    ("ANG_CLASS_BASED_GUARD", 0.92, "medium", "angular"), ("ANG_CLASS_BASED_RESOLVER", 0.92, "medium", "angular"),
    ("ANG_MODULE_WITH_PROVIDERS", 0.88, "low", "angular"), ("ANG_LEGACY_ROUTER_CONFIG", 0.85, "medium", "angular"),
    ("ANG_APP_INITIALIZER_CLASS", 0.80, "low", "angular"), ("ANG_CD_DEFAULT", 0.90, "low", "angular"),
    ("ANG_BARREL_COUPLING", 0.75, "low", "architecture"), ("ANG_COMPONENT_FACTORY", 0.90, "high", "angular"),
    ("RXJS_PATCH_IMPORTS", 0.99, "high", "rxjs"), ("RXJS_NON_PIPEABLE", 0.85, "high", "rxjs"),
    ("RXJS_SUBSCRIPTION_LEAK", 0.70, "high", "rxjs"), ("RXJS_SUBJECT_BUS", 0.65, "medium", "rxjs"),
    ("RXJS_TO_PROMISE", 0.95, "medium", "rxjs"), ("RXJS_THROW_ERROR_STRING", 0.95, "medium", "rxjs"),
    ("TMPL_NGMODEL_MISSING_IMPORT", 0.90, "high", "template"), ("TMPL_PIPE_MISSING_IMPORT", 0.90, "high", "template"),
    ("TMPL_ASYNC_WITHOUT_ONPUSH", 0.75, "low", "template"), ("TMPL_OLD_STRUCTURAL_DIRECTIVE", 0.75, "low", "template"),
    ("ARCH_CIRCULAR_DEPENDENCY", 1.0, "critical", "architecture"), ("PKG_INCOMPATIBLE_PEER", 1.0, "critical", "package"),
    ("PKG_MAJOR_UPGRADE_REQUIRED", 0.85, "high", "package"), ("PKG_UNVERIFIED_COMPAT", 0.60, "medium", "package"),
]
#: What a work item is called by its reason; any other is called by reason and category.
TITLES = {
    "ANG_CLASS_BASED_GUARD": "Convert class-based guard to functional guard",
    "ANG_CLASS_BASED_RESOLVER": "Convert class-based resolver to functional resolver",
    "ANG_NGMODULE_HEAVY": "Migrate NgModule-based artifact to standalone",
    "ANG_ENTRY_COMPONENTS": "Remove entryComponents from NgModule",
    "ANG_COMPONENT_FACTORY": "Replace ComponentFactoryResolver with ViewContainerRef.createComponent()",
    "ANG_LEGACY_ROUTER_CONFIG": "Migrate forRoot/forChild to provideRouter()",
    "RXJS_PATCH_IMPORTS": "Replace RxJS patch imports with pipeable operators",
    "RXJS_NON_PIPEABLE": "Refactor non-pipeable operators to pipe() syntax",
    "RXJS_SUBSCRIPTION_LEAK": "Fix subscription leak with takeUntilDestroyed()",
    "RXJS_TO_PROMISE": "Replace toPromise() with firstValueFrom()",
    "RXJS_THROW_ERROR_STRING": "Fix throwError() to use factory function",
    "TMPL_NGMODEL_MISSING_IMPORT": "Add FormsModule to standalone component imports",
    "TMPL_PIPE_MISSING_IMPORT": "Add missing pipe to standalone component imports",
    "ARCH_CIRCULAR_DEPENDENCY": "Resolve circular module dependency",
}
#: Packages whose major follows the framework's, and those with exceptions; None is an unknown state.
FOLLOWING = ["@ngrx/store", "@ngrx/effects", "@ngrx/entity", "@ngrx/router-store", "@ngrx/component-store", "@angular/material", "@angular/cdk", "@rx-angular/state", "@rx-angular/push", "@rx-angular/cdk"]
MAJORS = [14, 15, 16, 17, 18]


def package_rules() -> list[tuple[str, bool, int, int, str | None]]:
    """pattern, exact, ordinal, framework's major, required range."""
    rows: list[tuple[str, bool, dict[int, str | None]]] = [(p, True, {m: f">={m}.0.0" for m in MAJORS}) for p in FOLLOWING]
    rows += [
        ("@ngrx/signals", True, {m: f">={m}.0.0" for m in (17, 18)}),
        ("@angular/flex-layout", True, {m: None if m >= 16 else f">={m}.0.0" for m in MAJORS}),
        ("@rx-angular/", False, {m: f">={m}.0.0" for m in MAJORS}),
        ("@angular/fire", True, {m: ">=7.0.0" if m <= 15 else f">={m}.0.0" for m in MAJORS}),
        ("ngx-", False, dict.fromkeys(MAJORS)),
    ]
    return [(p, exact, i, m, need) for i, (p, exact, by) in enumerate(rows) for m, need in by.items()]


def reasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "reason_code string, confidence double, severity string, category string")


def packages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(package_rules(), "pattern string, exact boolean, ordinal int, major int, required string")


def sql_values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)
