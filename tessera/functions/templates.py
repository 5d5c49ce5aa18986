"""Templates with values, filters, conditions, loops, macros and includes, compiled to one column expression when the plan is made.

``{{ a.b | upper }}`` prints a value (null as nothing); ``{% if a == 'x' %}..{% elif b %}..{% else %}..{% endif %}`` chooses;
``{% for m in list %}..{% endfor %}`` repeats for each element of an array, with ``loop.index``, ``index0``, ``first``, ``last``,
``length`` and ``revindex``; ``{% set x = a + 1 %}`` names a value up to the end of its block; ``{% macro f(a, b='x') %}..{% endmacro %}``
is called as ``{{ f(1) }}``; ``{% include 'name' %}`` takes a template from a mapping; ``{# .. #}`` is left out; a minus inside
a mark takes the white space beside it away.  What a loop is to carry from one element to the next lies in a namespace:
``{% set ns = namespace(n=0) %}``, ``{% set ns.n = ns.n + 1 %}``; such a loop becomes an ``aggregate`` over a struct of its text and
the namespace's fields, other loops a ``transform``.

Names are columns, fields of structs, loop elements, set names and arguments.  Text is never evaluated as code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = tuple[Column, T.DataType]
MARKS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+\-*/%~|().,\[\]=]))")
LOOP = ("index", "index0", "revindex", "first", "last", "length")
FILTERS: dict[str, Callable[[Value, str], Value]] = {
    "upper": lambda v, _: (F.upper(printed(v)), T.StringType()),
    "lower": lambda v, _: (F.lower(printed(v)), T.StringType()),
    "trim": lambda v, _: (F.trim(printed(v)), T.StringType()),
    "length": lambda v, _: (F.coalesce(F.size(v[0]) if isinstance(v[1], T.ArrayType) else F.length(v[0]), F.lit(0)), T.IntegerType()),
    "join": lambda v, between: (F.array_join(v[0].cast("array<string>"), between), T.StringType()),
    "default": lambda v, other: (F.coalesce(v[0].cast("string"), F.lit(other)), T.StringType()),
    "tojson": lambda v, _: (F.to_json(v[0]), T.StringType()),
    "first": lambda v, _: (F.get(v[0], F.lit(0)), v[1].elementType),
    "last": lambda v, _: (F.try_element_at(v[0], F.lit(-1)), v[1].elementType),
}


def printed(value: Value) -> Column:
    return F.coalesce(value[0].cast("string"), F.lit(""))


def true(value: Value) -> Column:
    """Null, empty and zero values are false."""
    column, kind = value
    if isinstance(kind, T.ArrayType):
        found = F.size(column) > 0
    elif isinstance(kind, T.StringType):
        found = column != ""
    elif isinstance(kind, T.NumericType):
        found = column != 0
    else:
        found = column if isinstance(kind, T.BooleanType) else column.isNotNull()
    return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Macro:
    names: list[str]
    defaults: dict[str, str]
    body: list


@dataclass
class Scope:
    """What names stand for: values, namespaces (dicts of values), macros and templates."""

    names: dict[str, Value | dict[str, Value] | Macro]
    includes: dict[str, str] = field(default_factory=dict)
    depth: int = 0

    def inner(self, **more: Value | dict[str, Value]) -> Scope:
        spaces = {n: dict(v) for n, v in self.names.items() if isinstance(v, dict)}
        return Scope(self.names | spaces | more, self.includes, self.depth)


class Expression:
    """A value by precedence: or, and, not, comparison, ~, + and -, * / %, filters, fields and calls."""

    def __init__(self, text: str, scope: Scope):
        self.text, self.scope, self.tokens, self.at, end = text, scope, [], 0, 0
        text = text.rstrip()
        while end < len(text):
            m = TOKEN.match(text, end)
            if not m:
                raise ValueError(f"{text[end:].strip()!r} is left over in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            end = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if not self.peek(*values):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, value: str) -> None:
        if not self.take(value):
            raise ValueError(f"{value!r} is missing in {self.text!r}")

    def whole(self) -> Value:
        value = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} is left over in {self.text!r}")
        return value

    def either(self) -> Value:
        value = self.both()
        while self.take("or"):
            value = (true(value) | true(self.both()), T.BooleanType())
        return value

    def both(self) -> Value:
        value = self.negated()
        while self.take("and"):
            value = (true(value) & true(self.negated()), T.BooleanType())
        return value

    def negated(self) -> Value:
        return (~true(self.negated()), T.BooleanType()) if self.take("not") else self.compared()

    def compared(self) -> Value:
        left = self.joined()
        if self.take("is"):
            no = bool(self.take("not"))
            test = self.take("none", "defined")
            found = {"none": left[0].isNull(), "defined": F.lit(not isinstance(left[1], T.NullType))}.get(test or "")
            if found is None:
                raise ValueError(f"unknown test in {self.text!r}")
            return (~found if no else found), T.BooleanType()
        no = bool(self.peek("not") and self.take("not"))
        if self.take("in"):
            right = self.joined()
            found = F.array_contains(right[0], left[0]) if isinstance(right[1], T.ArrayType) else F.contains(right[0], left[0].cast("string"))
            found = F.coalesce(found, F.lit(False))
            return (~found if no else found), T.BooleanType()
        sign = self.take("==", "!=", "<=", ">=", "<", ">")
        if not sign:
            return left
        a, b = left[0], self.joined()[0]
        found = {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[sign]
        return F.coalesce(found, F.lit(False)), T.BooleanType()

    def joined(self) -> Value:
        value = self.summed()
        while self.take("~"):
            value = (F.concat(printed(value), printed(self.summed())), T.StringType())
        return value

    def summed(self) -> Value:
        value = self.multiplied()
        while sign := self.take("+", "-"):
            value = self.reckoned(value, sign, self.multiplied())
        return value

    def multiplied(self) -> Value:
        value = self.filtered()
        while sign := self.take("*", "/", "%"):
            value = self.reckoned(value, sign, self.filtered())
        return value

    def reckoned(self, a: Value, sign: str, b: Value) -> Value:
        if sign == "+" and (isinstance(a[1], T.StringType) or isinstance(b[1], T.StringType)):
            return F.concat(a[0].cast("string"), b[0].cast("string")), T.StringType()
        whole = all(isinstance(v[1], T.IntegralType) for v in (a, b)) and sign != "/"
        x, y = (v[0].cast("long" if whole else "double") for v in (a, b))
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.pmod(x, F.nullif(y, F.lit(0)))}[sign]()
        return out, T.LongType() if whole else T.DoubleType()

    def filtered(self) -> Value:
        value = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name not in FILTERS:
                raise ValueError(f"no filter {name}")
            self.at += 1
            argument = ""
            if self.take("("):
                argument = self.tokens[self.at][1][1:-1]
                self.at += 1
                self.need(")")
            value = FILTERS[name](value, argument)
        return value

    def atom(self) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError(f"no value in {self.text!r}")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            value: Value = (F.lit(token[1:-1]), T.StringType())
        elif kind == "number":
            value = (F.lit(float(token)), T.DoubleType()) if "." in token else (F.lit(int(token)).cast("long"), T.LongType())
        elif token == "-":
            inner = self.atom()
            value = (-inner[0], inner[1])
        elif token == "(":
            value = self.either()
            self.need(")")
        elif kind == "name":
            value = self.named(token)
        else:
            raise ValueError(f"no value in {self.text!r}")
        while self.take("."):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            if not isinstance(value[1], T.StructType) or name not in value[1].names:
                raise ValueError(f"{name} in {self.text!r} names no field")
            value = (value[0][name], value[1][name].dataType)
        while self.take("["):
            place = self.either()[0].cast("int")
            self.need("]")
            value = (F.try_element_at(value[0], F.when(place < 0, place).otherwise(place + 1)), value[1].elementType)
        return value

    def named(self, name: str) -> Value:
        if name in ("true", "false", "none"):
            return {"true": (F.lit(True), T.BooleanType()), "false": (F.lit(False), T.BooleanType()), "none": (F.lit(None), T.NullType())}[name]
        found = self.scope.names.get(name)
        if found is None:
            if self.peek("is"):
                return F.lit(None), T.NullType()
            raise ValueError(f"a template names {name}, which is no column")
        if isinstance(found, Macro):
            return called(name, found, self.arguments(), self.scope)
        if isinstance(found, dict):
            self.need(".")
            of = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            self.at += 1
            if of not in found:
                raise ValueError(f"{name}.{of} names no field")
            return found[of]
        return found

    def arguments(self) -> tuple[list[Value], dict[str, Value]]:
        self.need("(")
        places, names = [], {}
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("sign", "="):
                name = self.tokens[self.at][1]
                self.at += 2
                names[name] = self.either()
            else:
                places.append(self.either())
            if not self.peek(")"):
                self.need(",")
        return places, names


def called(name: str, macro: Macro, given: tuple[list[Value], dict[str, Value]], scope: Scope) -> Value:
    if scope.depth > 20:
        raise ValueError(f"{name} calls itself")
    places, names = given
    if len(places) > len(macro.names) or set(names) - set(macro.names):
        raise ValueError(f"too many arguments for {name}")
    values = dict(zip(macro.names, places, strict=False)) | names
    for missing in macro.names:
        if missing not in values:
            values[missing] = Expression(macro.defaults[missing], scope).whole() if missing in macro.defaults else (F.lit(None).cast("string"), T.StringType())
    inner = scope.inner(**values)
    inner.depth += 1
    return shown(macro.body, inner), T.StringType()


def parsed(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """Nodes up to a tag that begins with one of ``ends``, and where that is."""
    out: list = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            out.append(("print", inside_of(part)))
        elif part.startswith("{%"):
            word, rest = tag_of(part)
            if word in ends:
                return out, at
            if word == "if":
                cases, other = [], []
                while word in ("if", "elif"):
                    inside, at = parsed(parts, at + 1, ("elif", "else", "endif"))
                    cases.append((rest, inside))
                    word, rest = tag_of(parts[at])
                if word == "else":
                    other, at = parsed(parts, at + 1, ("endif",))
                out.append(("if", cases, other))
            elif word == "for":
                inside, at = parsed(parts, at + 1, ("endfor",))
                name, _, source = rest.partition(" in ")
                out.append(("for", name.strip(), source, inside))
            elif word == "set":
                name, equal, value = rest.partition("=")
                if not equal:
                    raise ValueError(f"nothing is set in {part!r}")
                out.append(("set", name.strip(), value.strip()))
            elif word == "macro":
                m = re.fullmatch(r"(\w+)\s*\((.*)\)", rest, re.S)
                if not m:
                    raise ValueError(f"no macro in {part!r}")
                inside, at = parsed(parts, at + 1, ("endmacro",))
                taken = [a.partition("=") for a in re.findall(r"\w+\s*(?:=\s*(?:'[^']*'|\"[^\"]*\"|[^,]+))?", m[2])]
                out.append(("macro", m[1], Macro([a.strip() for a, _, _ in taken], {a.strip(): d.strip() for a, e, d in taken if e}, inside)))
            elif word == "include":
                out.append(("include", rest.strip("'\" ")))
            else:
                raise ValueError(f"unknown tag {part!r}")
        elif part and not part.startswith("{#"):
            out.append(("text", part))
        at += 1
    if ends:
        raise ValueError(f"no {ends[-1]}")
    return out, at


def inside_of(part: str) -> str:
    """What stands in a mark, without the minus that belongs to it."""
    return part[2:-2].removeprefix("-").removesuffix("-").strip()


def tag_of(part: str) -> tuple[str, str]:
    word, _, rest = inside_of(part).partition(" ")
    return word, rest.strip()


def template(pattern: str) -> list:
    """The nodes of a template, white space beside marks with a minus taken away."""
    parts = MARKS.split(pattern)
    for k in range(1, len(parts), 2):
        if parts[k][2] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    return parsed([p for p in parts if p], 0, ())[0]


def merged(test: Column, new: Value, old: Value | None) -> Value:
    """The new value where the test holds, else the old one; as text if they are of different types."""
    if old is None or isinstance(old[1], T.NullType):
        return F.when(test, new[0]), new[1]
    if new[1] != old[1]:
        numbers = isinstance(new[1], T.NumericType) and isinstance(old[1], T.NumericType)
        kind = T.DoubleType() if numbers else T.StringType()
        return F.when(test, new[0].cast(kind)).otherwise(old[0].cast(kind)), kind
    return F.when(test, new[0]).otherwise(old[0]), new[1]


def carried(nodes: list) -> set[tuple[str, str]]:
    """(namespace, field) set anywhere in the nodes."""
    out: set[tuple[str, str]] = set()
    for node in nodes:
        if node[0] == "set" and "." in node[1]:
            out.add(tuple(node[1].split(".", 1)))
        elif node[0] == "for":
            out |= carried(node[3])
        elif node[0] == "if":
            out |= carried(node[2]).union(*[carried(inside) for _, inside in node[1]])
    return out


def shown(nodes: list, scope: Scope) -> Column:
    """The text of the nodes; sets change the scope for the nodes after them."""
    out: list[Column] = []
    for node in nodes:
        if node[0] == "text":
            out.append(F.lit(node[1]))
        elif node[0] == "print":
            out.append(printed(Expression(node[1], scope).whole()))
        elif node[0] == "macro":
            scope.names[node[1]] = node[2]
        elif node[0] == "include":
            if node[1] not in scope.includes:
                raise ValueError(f"no template {node[1]}")
            if scope.depth > 20:
                raise ValueError(f"{node[1]} includes itself")
            inner = scope.inner()
            inner.depth += 1
            out.append(shown(template(scope.includes[node[1]]), inner))
        elif node[0] == "set":
            assign(node[1], node[2], scope)
        elif node[0] == "if":
            out.append(chosen(node[1], node[2], scope))
        else:
            out.append(repeated(*node[1:], scope))
    return F.concat(*out) if out else F.lit("")


def assign(name: str, text: str, scope: Scope) -> None:
    made = re.fullmatch(r"namespace\s*(\(.*\))", text, re.S)
    if made:
        places, names = Expression(made[1], scope).arguments()
        if places:
            raise ValueError("a namespace has named values only")
        scope.names[name] = names
        return
    value = Expression(text, scope).whole()
    if "." not in name:
        scope.names[name] = value
        return
    space, of = name.split(".", 1)
    if not isinstance(scope.names.get(space), dict):
        raise ValueError(f"{space} is no namespace")
    scope.names[space][of] = value


def chosen(cases: list, other: list, scope: Scope) -> Column:
    tests = [true(Expression(test, scope).whole()) for test, _ in cases]
    ways = [scope.inner() for _ in cases] + [scope.inner()]
    texts = [shown(inside, way) for inside, way in zip([inside for _, inside in cases] + [other], ways, strict=True)]
    text, last = texts[-1], ways[-1]
    for test, here, way in reversed(list(zip(tests, texts[:-1], ways[:-1], strict=True))):
        text = F.when(test, here).otherwise(text)
        for name in way.names | last.names:
            new, old, before = way.names.get(name), last.names.get(name), scope.names.get(name)
            if isinstance(new, dict) or isinstance(old, dict):
                last.names[name] = {k: merged(test, (new or old)[k], (old or new).get(k)) if k in (new or old) else (old or new)[k] for k in (new or {}) | (old or {})}
            elif isinstance(new, Macro) or isinstance(old, Macro) or new is old:
                last.names[name] = new or old
            else:
                value = new or (before if isinstance(before, tuple) else (F.lit(None), T.NullType()))
                last.names[name] = merged(test, value, old) if not isinstance(value[1], T.NullType) else (F.when(~test, old[0]), old[1])
    scope.names.update(last.names)
    return text


def repeated(name: str, source: str, inside: list, scope: Scope) -> Column:
    column, kind = Expression(source, scope).whole()
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{source} is no array")
    n = F.size(column)

    def around(element: Column, i: Column) -> dict[str, Value | dict[str, Value]]:
        at = {"index": i + 1, "index0": i, "revindex": n - i, "first": i == 0, "last": i == n - 1, "length": n}
        return {name: (element, kind.elementType), "loop": {k: (v, T.BooleanType() if k in ("first", "last") else T.IntegerType()) for k, v in at.items()}}

    fields = sorted(f for f in carried(inside) if isinstance(scope.names.get(f[0]), dict))
    if not fields:
        text = lambda element, i: shown(inside, scope.inner(**around(element, i)))
        return F.coalesce(F.array_join(F.transform(column, text), ""), F.lit(""))
    kinds, begins = {}, {}
    for space, of in fields:
        value = scope.names[space].get(of, (F.lit(None), T.NullType()))
        kinds[space, of] = T.DoubleType() if isinstance(value[1], T.FractionalType) else T.LongType() if isinstance(value[1], T.IntegralType) else T.StringType() if isinstance(value[1], T.NullType) else value[1]
        begins[space, of] = value[0].cast(kinds[space, of])
    label = {f: f"v{k}" for k, f in enumerate(fields)}
    packed = lambda text, values: F.struct(text.alias("text"), *[values[f].alias(label[f]) for f in fields])

    def step(acc: Column, i: Column) -> Column:
        inner = scope.inner(**around(F.get(column, i), i))
        for space, of in fields:
            inner.names[space][of] = (acc[label[space, of]], kinds[space, of])
        text = shown(inside, inner)
        return packed(F.concat(acc["text"], text), {f: inner.names[f[0]][f[1]][0].cast(kinds[f]) for f in fields})

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(places, packed(F.lit(""), begins), step)
    for space, of in fields:
        scope.names[space][of] = (done[label[space, of]], kinds[space, of])
    return done["text"]


def rendered(df: DataFrame, pattern: str, includes: dict[str, str] | None = None, **more: str) -> Column:
    """The template's text for each row of df; ``more`` are names with one value for all rows, such as a mode."""
    names: dict[str, Value | dict[str, Value] | Macro] = {f.name: (F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields}
    names |= {name: (F.lit(v), T.StringType()) for name, v in more.items()}
    return shown(template(pattern), Scope(names, includes or {}))
