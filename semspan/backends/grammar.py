"""A small grammar of instructions: the shapes that recur in analytical questions.

It serves twice. The rule backend answers by it, one record at a time; and the optimizer
turns an instruction it recognises into a Spark SQL expression, so that no model is asked at
all. Both readings of a rule stand side by side here, and the tests hold them to one another.
Numbers are read from formatted text ('$1,250.50', '8.1/10') as its first number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

_NUMBER = re.compile(r"-?\d[\d,]*(?:\.\d+)?|-?\.\d+")
_SQL_NUMBER = "try_cast(replace(regexp_extract({c}, '-?[0-9][0-9,]*(?:[.][0-9]+)?|-?[.][0-9]+', 0), ',', '') as double)"


def first_number(text: object) -> float | None:
    hit = _NUMBER.search(str(text))
    return float(hit.group(0).replace(",", "")) if hit else None


def sql_number(column: str) -> str:
    return _SQL_NUMBER.format(c=f"cast({column} as string)")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Predicate:
    """A yes/no question about one value, in Python and in SQL."""

    test: Callable[[str], bool]
    sql: Callable[[str], str]


_COMPARE = [
    (r"(?:at least|not less than|not lower than)", ">=", lambda a, b: a >= b),
    (r"(?:at most|not more than|not higher than)", "<=", lambda a, b: a <= b),
    (r"(?:higher|greater|more|larger|bigger|longer|above|over|later) ?(?:than)?", ">", lambda a, b: a > b),
    (r"(?:lower|less|smaller|fewer|shorter|below|under|earlier|cheaper) ?(?:than)?", "<", lambda a, b: a < b),
    (r"(?:equal to|exactly)", "=", lambda a, b: a == b),
]
_QUOTED = r"[\"'“‘]([^\"'”’]+)[\"'”’]"


def predicate(instruction: str) -> Predicate | None:
    """The predicate an instruction states, if the grammar knows its shape."""
    text = instruction.strip().rstrip(".?!")
    low = text.lower()
    negate = bool(re.search(r"\b(?:not contain|does not mention|is not|without)\b", low))

    def word(pattern: str, test, sql) -> Predicate | None:
        hit = re.search(pattern, text, re.IGNORECASE)
        if not hit:
            return None
        term = hit.group(1).strip()
        if negate:
            return Predicate(lambda v: not test(v, term), lambda c: f"not ({sql(c, term)})")
        return Predicate(lambda v: test(v, term), lambda c: sql(c, term))

    contains = lambda v, t: t.lower() in v.lower()
    contains_sql = lambda c, t: f"contains(lower(cast({c} as string)), {quote(t.lower())})"
    for pattern, symbol, compare in _COMPARE:
        hit = re.search(rf"\b{pattern}\s+\$?(-?\d[\d,]*(?:\.\d+)?)", low)
        if hit:
            bound = float(hit.group(1).replace(",", ""))

            def check(v: str, bound: float = bound, compare=compare) -> bool:
                n = first_number(v)
                return n is not None and compare(n, bound)

            return Predicate(
                check, lambda c, s=symbol, b=bound: f"coalesce({sql_number(c)} {s} cast({b!r} as double), false)"
            )
    return (
        word(rf"(?:starts?|begins?) with {_QUOTED}", lambda v, t: v.lower().startswith(t.lower()),
             lambda c, t: f"startswith(lower(cast({c} as string)), {quote(t.lower())})")
        or word(rf"ends? with {_QUOTED}", lambda v, t: v.lower().endswith(t.lower()),
                lambda c, t: f"endswith(lower(cast({c} as string)), {quote(t.lower())})")
        or word(rf"(?:contains?|mentions?|includes?|has|about|supports?|not contain|not mention) {_QUOTED}", contains, contains_sql)
        or word(r"(?:directed|developed|published|written) by ([A-Z][\w .'-]*)", contains, contains_sql)
        or word(rf"(?:is|equals|are) (?:not )?{_QUOTED}", lambda v, t: v.strip().lower() == t.lower(),
                lambda c, t: f"lower(trim(cast({c} as string))) = {quote(t.lower())}")
    )


@dataclass(frozen=True)
class Mapping:
    """A new value from one value, in Python and in SQL. None is no value."""

    value: Callable[[str], str | None]
    sql: Callable[[str], str]


def mapping(instruction: str) -> Mapping | None:
    low = instruction.lower()
    if hit := re.search(r"classif\w+ .*?\b(?:as|into)\b (?:one of )?(.+)", instruction.strip().rstrip("."), re.IGNORECASE):
        options = [o.strip() for o in re.split(r",\s*(?:or |and )?|\s+or\s+|\s+and\s+", hit.group(1)) if o.strip()]
        if len(options) > 1:
            *named, other = options

            def choose(v: str) -> str:
                return next((o for o in named if o.lower() in v.lower()), other)

            cases = " ".join(f"when contains(lower(cast({{c}} as string)), {quote(o.lower())}) then {quote(o)}" for o in named)
            return Mapping(choose, lambda c: f"case {cases.replace('{c}', c)} else {quote(other)} end")
    if re.search(r"\b(?:upper ?case|capital letters)\b", low):
        return Mapping(lambda v: v.upper(), lambda c: f"upper(cast({c} as string))")
    if re.search(r"\blower ?case\b", low):
        return Mapping(lambda v: v.lower(), lambda c: f"lower(cast({c} as string))")
    if re.search(r"\bfirst word\b", low):
        return Mapping(
            lambda v: (re.search(r"\S+", v) or [""])[0], lambda c: f"regexp_extract(cast({c} as string), '\\\\S+', 0)"
        )
    if re.search(r"\b(?:number of characters|how long)\b", low):
        return Mapping(lambda v: str(len(v)), lambda c: f"cast(char_length(cast({c} as string)) as string)")
    if re.search(r"\b(?:extract|find|give|convert|what is)\b.*\b(?:number|price|amount|count|year|rating|usd)\b", low):

        def number(v: str) -> str | None:
            n = first_number(v)
            return None if n is None else f"{n:.2f}"

        return Mapping(number, lambda c: f"cast(cast({sql_number(c)} as decimal(38,2)) as string)")
    return None


#: Words of an instruction, aggregate, whether it needs numbers.
_AGGREGATES = (
    (r"\bhow many numbers\b", "numbers", True),
    (r"\b(?:how many|count|number of)\b", "count", False),
    (r"\b(?:most (?:frequent|common)|mode)\b", "mode", False),
    (r"\b(?:earliest|first date)\b", "first", False),
    (r"\b(?:latest|last date)\b", "last", False),
    (r"\b(?:average|mean)\b", "avg", True),
    (r"\b(?:total|sum)\b", "sum", True),
    (r"\b(?:maximum|highest|largest|max)\b", "max", True),
    (r"\b(?:minimum|lowest|smallest|min)\b", "min", True),
)


def aggregate(instruction: str) -> tuple[str, bool] | None:
    """(aggregate, needs numbers) that an instruction asks for."""
    low = instruction.lower()
    return next(((name, numeric) for pattern, name, numeric in _AGGREGATES if re.search(pattern, low)), None)


def in_place_of_average(instruction: str, wanted: str) -> str:
    """The same question about something else than the average."""
    return re.sub(r"\b(?:average|mean)\b", wanted, instruction, flags=re.IGNORECASE)


def aggregate_values(instruction: str, values: list[str], times: list[int] | None = None) -> str | None:
    """The answer over all values; ``times`` says how often each is there, once if it is not given."""
    found = aggregate(instruction)
    if not found:
        return None
    name, numeric = found
    if name == "count":
        return str(len(values))
    if name == "numbers":
        return str(sum(first_number(v) is not None for v in values))
    if name == "mode":
        top = Counter()
        for v, n in zip(values, times or [1] * len(values)):
            top[v] += n
        return min(top, key=lambda v: (-top[v], v)) if top else None
    if name in ("first", "last"):
        return (min if name == "first" else max)(values, default=None)
    numbers = [n for n in map(first_number, values) if n is not None]
    if not numbers:
        return None
    result = {"avg": lambda: sum(numbers) / len(numbers), "sum": lambda: sum(numbers), "max": lambda: max(numbers),
              "min": lambda: min(numbers)}[name]()
    return repr(round(result, 6))


def aggregate_sql(instruction: str, column: str) -> str | None:
    """The same as one aggregate expression, as text."""
    found = aggregate(instruction)
    if not found:
        return None
    name, _ = found
    text, number = f"cast({column} as string)", sql_number(column)
    return {
        "count": f"cast(count({column}) as string)",
        "numbers": f"cast(count({number}) as string)",
        "mode": f"mode({text}, true)",
        "first": f"min({text})",
        "last": f"max({text})",
        "avg": f"cast(round(avg({number}), 6) as string)",
        "sum": f"cast(round(sum({number}), 6) as string)",
        "max": f"cast(round(max({number}), 6) as string)",
        "min": f"cast(round(min({number}), 6) as string)",
    }[name]


def better(instruction: str, a: str, b: str) -> bool:
    """Whether ``a`` meets a ranking criterion better than ``b``."""
    low = instruction.lower()
    if re.search(r"\b(?:alphabet|name order|a to z)", low):
        return a < b
    if re.search(r"\b(?:longest|longer|length)\b", low):
        return len(a) > len(b)
    if re.search(r"\b(?:lowest|smallest|cheapest|least|fewest|earliest)\b", low):
        x, y = first_number(a), first_number(b)
        return x is not None and (y is None or x < y)
    x, y = first_number(a), first_number(b)
    if x is None and y is None:
        return a > b
    return x is not None and (y is None or x > y)


def belongs(instruction: str, left: str, right: str) -> bool:
    """Whether two values belong together under a join condition."""
    low = instruction.lower()
    if re.search(r"\bsame first letter\b", low):
        return left[:1].lower() == right[:1].lower() != ""
    if re.search(r"\b(?:treats?|mentions?|contains?|includes?|used for|suits?)\b", low):
        return left.lower() in right.lower() or right.lower() in left.lower()
    return left.strip().lower() == right.strip().lower()
