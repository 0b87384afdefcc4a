"""Column functions that read HTTP routes from decorator and annotation text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import join_route

# Decorator and annotation shapes.
VERB_DECORATOR = r"@\s*(\w+)\.(get|post|put|patch|delete|route|api_route|websocket)\(\s*[\"']([^\"']*)[\"']([^\n]*)"
METHODS_ARGUMENT = r"methods\s*=\s*\[\s*[\"'](\w+)"
MAPPING_ANNOTATION = (
    r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b(?:\s*\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\")?"
)
REQUEST_METHOD = r"RequestMethod\.(\w+)"
VERB_ANNOTATION = r"@(Get|Post|Put|Patch|Delete|All)\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)"
CONTROLLER_PREFIX = r"@Controller\(\s*['\"`]([^'\"`]*)['\"`]"
REQUEST_MAPPING_PREFIX = r"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\""
ROUTER_BINDING = r"(\w+)\s*=\s*(?:APIRouter|Blueprint)\(([^)]*)\)"
ROUTER_PREFIX = r"(?:url_)?prefix\s*=\s*[\"']([^\"']*)[\"']"


def router_prefixes(content: Column) -> Column:
    """array(struct(key, value)) of router variables of a file and their path prefixes, in order of binding."""
    bindings = F.regexp_extract_all(content, F.lit(ROUTER_BINDING), F.lit(0))
    arguments = lambda b: F.regexp_extract(b, ROUTER_BINDING, 2)
    return F.transform(
        F.filter(bindings, lambda b: arguments(b).rlike(ROUTER_PREFIX)),
        lambda b: F.struct(
            F.regexp_extract(b, ROUTER_BINDING, 1).alias("key"), F.regexp_extract(arguments(b), ROUTER_PREFIX, 1).alias("value")
        ),
    )


def decorator_route(header: Column, prefix: Column, prefixes: Column | None = None) -> Column:
    """'VERB /path' from the first decorator that declares a route, else null.

    `prefix` is the class prefix; `prefixes` from `router_prefixes` gives a router variable its own, the last one binding.
    """
    router = F.regexp_extract(header, VERB_DECORATOR, 1)
    action = F.regexp_extract(header, VERB_DECORATOR, 2)
    declared = F.regexp_extract(F.regexp_extract(header, VERB_DECORATOR, 4), METHODS_ARGUMENT, 1)
    verb = F.when(action.isin("route", "api_route"), F.when(declared != "", declared).otherwise("GET")).otherwise(action)
    bound = prefix
    if prefixes is not None:
        own = F.filter(prefixes, lambda p: p["key"] == router)
        bound = F.coalesce(F.try_element_at(own, F.lit(-1))["value"], prefix)
    called = F.concat_ws(" ", F.upper(verb), join_route(bound, F.regexp_extract(header, VERB_DECORATOR, 3)))

    mapping = F.regexp_extract(header, MAPPING_ANNOTATION, 1)
    requested = F.regexp_extract(header, REQUEST_METHOD, 1)
    mapping_verb = F.when(mapping == "Request", F.when(requested != "", requested).otherwise("ANY")).otherwise(mapping)
    mapped = F.concat_ws(" ", F.upper(mapping_verb), join_route(prefix, F.regexp_extract(header, MAPPING_ANNOTATION, 2)))

    annotated = F.concat_ws(
        " ",
        F.upper(F.regexp_extract(header, VERB_ANNOTATION, 1)),
        join_route(prefix, F.regexp_extract(header, VERB_ANNOTATION, 2)),
    )
    return (
        F.when(header.rlike(VERB_DECORATOR), called)
        .when(header.rlike(MAPPING_ANNOTATION), mapped)
        .when(header.rlike(VERB_ANNOTATION), annotated)
    )
