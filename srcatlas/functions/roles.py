"""Roles by name, and the layers that modules are scored on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name suffix and role, in match order.
SUFFIX_ROLES = [
    ("ScreenState.kt", "screenstate"),
    ("ScreenAction.kt", "screenaction"),
    ("ViewModel.kt", "viewmodel"),
    ("Screen.kt", "screen"),
    ("Fragment.kt", "screen"),
    ("UseCase.kt", "usecase"),
    ("Interactor.kt", "usecase"),
    ("RepositoryImpl.kt", "repository"),
    ("Repository.kt", "repository"),
    ("DataSource.kt", "datasource"),
    ("Service.kt", "service"),
    ("Module.kt", "di_module"),
    ("Graph.kt", "nav_graph"),
    ("Model.kt", "model"),
    ("Response.kt", "model"),
    ("ViewModel.swift", "viewmodel"),
    ("View.swift", "screen"),
    ("ViewController.swift", "screen"),
    ("Interactor.swift", "usecase"),
    ("UseCase.swift", "usecase"),
    ("Repository.swift", "repository"),
    ("Service.swift", "service"),
    ("Router.swift", "nav_graph"),
    ("Coordinator.swift", "nav_graph"),
    ("Model.swift", "model"),
    ("State.swift", "screenstate"),
    ("Reducer.swift", "reducer"),
]
# Layers of an exemplar and the suffixes that show them.
KOTLIN_LAYERS = {
    "viewmodel": ["ViewModel.kt"],
    "screen": ["Screen.kt", "Fragment.kt", "Activity.kt"],
    "state": ["State.kt", "ScreenState.kt", "UIState.kt"],
    "usecase": ["UseCase.kt", "Interactor.kt"],
    "repository": ["Repository.kt", "RepositoryImpl.kt"],
    "service": ["Service.kt", "Api.kt", "DataSource.kt"],
}
SWIFT_LAYERS = {
    "viewmodel": ["ViewModel.swift"],
    "view": ["View.swift", "ViewController.swift"],
    "state": ["State.swift", "Reducer.swift"],
    "usecase": ["UseCase.swift", "Interactor.swift"],
    "repository": ["Repository.swift"],
    "service": ["Service.swift", "API.swift", "DataSource.swift"],
}
# Layers of the feature search, by substring of the path.
SEARCH_LAYERS = {"ViewModel": ["ViewModel"], "Screen": ["Screen", "Fragment"], "UseCase": ["UseCase", "Interactor"], "Repository": ["Repository"], "Service": ["Service", "DataSource"]}
# Contract roles, and what names and annotations stand for.
CONTRACT_ROLES = ["base_viewmodel", "marker_interface", "ui_contract", "extension_container", "service"]
CONTRACT_ENDINGS = ["State", "Effect", "Action", "Event", "Intent"]
SERVICE_ANNOTATIONS = ["Singleton", "ActivityRetainedScoped", "ViewModelScoped"]
CONTAINER_ENDINGS = ["Ext", "Extensions", "Utils", "Util"]
# Directories whose files are ranked first.
PRIORITY_SEGMENTS = ["core/", "base/", "shared/", "common/", "foundation/"]
# Limits of distance for relevance.
RELEVANCE = [(0.6, "high"), (1.0, "medium")]


def ends_with_any(c: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | c.endswith(e)
    return out


def contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def arch_role(path: Column) -> Column:
    """Role by the first matching file-name suffix, else `other`."""
    (first, role), *rest = SUFFIX_ROLES
    out = F.when(path.endswith(first), role)
    for suffix, role in rest:
        out = out.when(path.endswith(suffix), role)
    return out.otherwise("other")


def relevance(score: Column) -> Column:
    (a, first), (b, second) = RELEVANCE
    return F.when(score <= a, first).when(score <= b, second).otherwise("low")


def is_contract(role: Column) -> Column:
    return F.coalesce(role.isin(CONTRACT_ROLES), F.lit(False))


def is_priority(path: Column) -> Column:
    return contains_any(F.lower(path), PRIORITY_SEGMENTS)
