"""Packrat parsing of parsing-expression grammars over token classes.

A lexer turns source into a string with one character per token; a grammar is text in PEG notation over token classes and literals.
Results of every rule are kept by position, so parsing takes linear time. Parts of a grammar that don't recurse are fused into one
possessive regular expression, which means the same; the slower unfused form is used to find the furthest position where a token was
refused.
"""

from __future__ import annotations

import re
import sys
from functools import cached_property

sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))

_DSL = re.compile(r"\s*(?:#[^\n]*|(<-)|('(?:[^'\\]|\\.)+')|([A-Za-z_]\w*)|([/*+?!&()]))")
_BASE = 0xE100
ERROR = "\ue000"


class Grammar:
    """rules: lines ``name <- expression``; upper-case names are the token classes given by classes, literals stand in quotes.

    soft: literals that are keywords in some places only and count as NAME too. ANY is any token; EOL matches nothing, where a line end
    stands before the token.
    """

    def __init__(self, rules: str, classes: str, soft: str = "", start: str = "file"):
        self.classes = {c: chr(_BASE + i) for i, c in enumerate(classes.split())}
        self.sym: dict[str, str] = {}
        self.soft = soft.split()
        self.start = start
        tokens = []
        for arrow, lit, name, op in _DSL.findall(rules):
            if arrow or lit or name or op:
                tokens.append(arrow or lit or name or op)
        for t in tokens:
            if t[0] == "'":
                self._symbol(re.sub(r"\\(.)", r"\1", t[1:-1]))
        for s in self.soft:
            self._symbol(s)
        self.rules: dict[str, tuple] = {}
        at = 0
        while at < len(tokens):
            assert tokens[at + 1] == "<-", tokens[at : at + 4]
            end = next((i - 1 for i in range(at + 2, len(tokens)) if tokens[i] == "<-"), len(tokens))
            node, stop = self._alt(tokens[:end], at + 2)
            assert stop == end, (tokens[at], tokens[stop : stop + 5])
            self.rules[tokens[at]] = node
            at = end

    def _symbol(self, text: str) -> str:
        return self.sym.setdefault(text, chr(_BASE + 100 + len(self.sym)))

    def _alt(self, t, i):
        parts = []
        while True:
            node, i = self._seq(t, i)
            parts.append(node)
            if i < len(t) and t[i] == "/":
                i += 1
            else:
                return (parts[0] if len(parts) == 1 else ("alt", parts)), i

    def _seq(self, t, i):
        parts = []
        while i < len(t) and t[i] not in ("/", ")"):
            sign = t[i] if t[i] in "!&" else ""
            i += bool(sign)
            if t[i] == "(":
                node, i = self._alt(t, i + 1)
                i += 1
            else:
                node, i = self._atom(t[i]), i + 1
            if i < len(t) and t[i] in ("*", "+", "?"):
                node, i = (t[i], node), i + 1
            parts.append((sign, node) if sign else node)
        return (parts[0] if len(parts) == 1 else ("seq", parts)), i

    def _atom(self, t):
        if t[0] == "'":
            return ("set", self._symbol(re.sub(r"\\(.)", r"\1", t[1:-1])))
        if t == "NAME":
            return ("set", self.classes["NAME"] + "".join(self._symbol(s) for s in self.soft))
        if t == "ANY":
            return ("any",)
        if t == "EOL":
            return ("eol",)
        if t in self.classes:
            return ("set", self.classes[t])
        return ("ref", t)

    @cached_property
    def _regular(self) -> set[str]:
        """Rules that reach no recursion."""
        refs = {name: set(_refs(node)) for name, node in self.rules.items()}
        for name, rs in refs.items():
            assert rs <= refs.keys(), (name, rs - refs.keys())
        done: set[str] = set()
        while more := {n for n, rs in refs.items() if n not in done and rs <= done and not _ends_lines(self.rules[n])}:
            done |= more
        return done

    @cached_property
    def _first(self) -> dict[str, tuple[frozenset | None, bool]]:
        """Of each rule the characters it can begin with (None: any) and whether it can match nothing."""
        known = {n: (frozenset(), False) for n in self.rules}
        while True:
            new = {n: self._begin(node, known) for n, node in self.rules.items()}
            if new == known:
                return known
            known = new

    def _begin(self, node, known):
        kind = node[0]
        if kind == "set":
            return frozenset(node[1]), False
        if kind == "any":
            return None, False
        if kind == "ref":
            return known[node[1]]
        if kind in ("!", "&", "eol"):
            return frozenset(), True
        if kind in ("*", "?"):
            return self._begin(node[1], known)[0], True
        if kind == "+":
            return self._begin(node[1], known)
        out: frozenset | None = frozenset()
        if kind == "alt":
            parts = [self._begin(p, known) for p in node[1]]
            return (None if any(f is None for f, _ in parts) else out.union(*(f for f, _ in parts))), any(e for _, e in parts)
        for p in node[1]:
            f, e = self._begin(p, known)
            out = None if f is None or out is None else out | f
            if not e:
                return out, False
        return out, True

    def _source(self, node) -> str:
        """The possessive regular expression of a node without recursion."""
        kind = node[0]
        if kind == "set":
            return re.escape(node[1]) if len(node[1]) == 1 else "[" + re.escape(node[1]) + "]"
        if kind == "any":
            return "(?s:.)"
        if kind == "ref":
            return self._source(self.rules[node[1]])
        if kind in ("!", "&"):
            return f"(?{'!' if kind == '!' else '='}{self._source(node[1])})"
        if kind in ("*", "+", "?"):
            return f"(?:{self._source(node[1])}){kind}+"
        if kind == "seq":
            return "".join(self._source(p) for p in node[1])
        return "(?>" + "|".join(self._source(p) for p in node[1]) + ")"

    def _is_regular(self, node) -> bool:
        return not _ends_lines(node) and all(r in self._regular for r in _refs(node))

    def parser(self, fused: bool = True, start: str | None = None):
        """A function of the token string: -1 if all of it is matched, else the position of the furthest refused token."""
        made: dict[str, object] = {}
        memo: dict[int, int] = {}
        state = ["", 0, frozenset()]  # the token string, the furthest refused position, the places after a line end
        names = {n: i for i, n in enumerate(self.rules)}
        total = len(names)

        def regex(node):
            match = re.compile(self._source(node)).match

            def go(pos):
                m = match(state[0], pos)
                if m:
                    return m.end()
                if pos > state[1]:
                    state[1] = pos
                return -1

            return go

        def build(node):
            kind = node[0]
            if fused and self._is_regular(node):
                return regex(node)
            if kind in ("set", "any"):
                return regex(node)
            if kind == "eol":
                return lambda pos: pos if pos in state[2] else -1
            if kind == "ref":
                return ref(node[1])
            if kind in ("!", "&"):
                inner, want = build(node[1]), kind == "&"

                def look(pos):
                    far = state[1]
                    got = inner(pos) >= 0
                    state[1] = far
                    return pos if got == want else -1

                return look
            if kind == "?":
                inner = build(node[1])

                def opt(pos):
                    end = inner(pos)
                    return pos if end < 0 else end

                return opt
            if kind in ("*", "+"):
                inner, least = build(node[1]), kind == "+"

                def many(pos):
                    end = inner(pos)
                    if end < 0:
                        return -1 if least else pos
                    while end > pos:
                        pos, end = end, inner(end)
                    return pos

                return many
            if kind == "seq":
                parts, run = [], []
                for p in node[1]:
                    if fused and self._is_regular(p):
                        run.append(p)
                        continue
                    if run:
                        parts.append(regex(("seq", run)))
                        run = []
                    parts.append(build(p))
                if run:
                    parts.append(regex(("seq", run)))
                return _sequence(tuple(parts))
            options = [(self._begin(p, self._first), build(p)) for p in node[1]]
            table: dict[str, tuple] = {}
            chars = set().union(*(f for (f, _), _ in options if f))
            for c in chars:
                table[c] = tuple(fn for (f, e), fn in options if f is None or e or c in f)
            other = tuple(fn for (f, e), fn in options if f is None or e)

            def alt(pos, get=table.get):
                for fn in get(state[0][pos : pos + 1], other):
                    end = fn(pos)
                    if end >= 0:
                        return end
                if pos > state[1]:
                    state[1] = pos
                return -1

            return alt

        uses: dict[str, int] = {}
        for node in self.rules.values():
            for r in _refs(node):
                uses[r] = uses.get(r, 0) + 1

        def ref(name):
            if name not in made and uses.get(name) == 1 and name not in _refs(self.rules[name]):
                # used in one place alone, whose own result is kept, so it isn't asked twice
                made[name] = build(self.rules[name])
            if name not in made:
                number = names[name]

                def rule(pos, get=memo.get):
                    key = pos * total + number
                    end = get(key)
                    if end is None:
                        end = memo[key] = body(pos)
                    return end

                made[name] = rule
                body = build(self.rules[name])
            return made[name]

        top = ref(start or self.start)

        def parse(tokens: str, line_ends: frozenset | set = frozenset()) -> int:
            memo.clear()
            state[:] = tokens, 0, line_ends
            end = top(0)
            return -1 if end == len(tokens) else max(state[1], end)

        return parse


def _sequence(parts: tuple):
    """One after the other; the usual numbers of parts are written out."""
    if len(parts) == 1:
        return parts[0]
    if len(parts) == 2:
        a, b = parts

        def two(pos):
            pos = a(pos)
            return b(pos) if pos >= 0 else -1

        return two
    if len(parts) == 3:
        a, b, c = parts

        def three(pos):
            pos = a(pos)
            if pos >= 0:
                pos = b(pos)
                if pos >= 0:
                    return c(pos)
            return -1

        return three

    def many(pos):
        for p in parts:
            pos = p(pos)
            if pos < 0:
                return -1
        return pos

    return many


def _refs(node):
    if node[0] == "ref":
        yield node[1]
    elif node[0] in ("seq", "alt"):
        for p in node[1]:
            yield from _refs(p)
    elif node[0] not in ("set", "any", "eol"):
        yield from _refs(node[1])


def _ends_lines(node) -> bool:
    if node[0] in ("seq", "alt"):
        return any(map(_ends_lines, node[1]))
    return node[0] == "eol" or (node[0] in ("!", "&", "*", "+", "?") and _ends_lines(node[1]))
