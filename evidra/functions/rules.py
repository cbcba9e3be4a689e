"""The two rule languages: parsed once on the driver, evaluated as columns."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: str) -> str:
    """Comparison text of a keyword."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").lower() if not c.isspace())


class RuleSyntaxError(ValueError):
    """A rule text that the language does not have; position counts from 1."""

    def __init__(self, what: str, at: int):
        super().__init__(f"{what} (position {at + 1})")
        self.position = at + 1


# --- keyword rules: "a" and not any("b", "c") or "d"; "e" ----------------------------------------------


@dataclass(frozen=True)
class Atom:
    """One keyword, or any of several, perhaps negated."""

    keywords: tuple[str, ...]
    negated: bool = False
    group: bool = False

    def __str__(self) -> str:
        inner = ", ".join(f'"{k}"' for k in self.keywords)
        return ("not " if self.negated else "") + (f"any({inner})" if self.group else inner)

    def column(self, text: Column) -> Column:
        hit = F.lit(False)
        for k in self.keywords:
            hit = hit | text.contains(plain(k))
        return ~hit if self.negated else hit


@dataclass(frozen=True)
class KeywordRule:
    """Branches (any must hold) of atoms (all must hold)."""

    branches: tuple[tuple[Atom, ...], ...]

    @property
    def source(self) -> str:
        return " or ".join(" and ".join(map(str, b)) for b in self.branches)

    def column(self, text: Column) -> Column:
        """Whether comparison text `text` satisfies the rule."""
        out = F.lit(False)
        for b in self.branches:
            all_ = F.lit(True)
            for a in b:
                all_ = all_ & a.column(text)
            out = out | all_
        return out


_LEX = re.compile(r'(?P<space>\s+)|"(?P<word>[^"]*)"|(?P<name>[A-Za-z]+)|(?P<mark>[(),;])|(?P<open>")|(?P<other>.)', re.S)


class _Keywords:
    """A reader over the lexemes (kind, text, position), white space between them noted."""

    def __init__(self, text: str):
        self.items, gap = [], True
        for m in _LEX.finditer(text):
            if m.lastgroup == "space":
                gap = True
                continue
            self.items.append((m.lastgroup, m.group(m.lastgroup), m.start(), gap))
            gap = False
        self.items.append(("end", "", len(text), True))
        self.at = 0

    @property
    def head(self):
        return self.items[self.at]

    def is_name(self, *names: str) -> bool:
        return self.head[0] == "name" and self.head[1].lower() in names

    def fail(self, what: str):
        raise RuleSyntaxError(what, self.head[2])

    def keyword(self) -> str:
        kind, text, _, _ = self.head
        if kind == "open":
            self.fail("a keyword lacks its closing quote")
        if kind != "word":
            self.fail("a keyword must be in quotes")
        if not text.strip():
            self.fail("a keyword must not be empty")
        self.at += 1
        return text

    def atom(self) -> Atom:
        negated = self.is_name("not")
        if negated:
            self.at += 1
            if not self.head[3]:
                self.fail("not must be followed by a blank")
            if self.is_name("not") or self.head[1] == "(":
                self.fail("not applies to one keyword or any(...)")
        if not self.is_name("any"):
            return Atom((self.keyword(),), negated)
        self.at += 1
        if self.head[1] != "(":
            self.fail("any needs parentheses")
        self.at += 1
        words, seen = [], set()
        while True:
            if self.is_name("any"):
                self.fail("any(...) cannot be nested")
            where = self.head[2]
            word = self.keyword()
            if plain(word) in seen:
                raise RuleSyntaxError("a keyword repeats in any(...)", where)
            seen.add(plain(word))
            words.append(word)
            kind, text, _, _ = self.head
            self.at += 1
            if kind == "mark" and text == ")":
                return Atom(tuple(words), negated, True)
            if kind != "mark" or text != ",":
                self.at -= 1
                self.fail("keywords in any(...) must be parted by commas")

    def rule(self) -> KeywordRule:
        branches, start = [[self.atom()]], [self.head[2]]
        while self.head[0] != "end" and self.head[1] != ";":
            if not self.head[3]:
                self.fail("a blank must part keywords and connectives")
            word = self.head[1].lower()
            if not self.is_name("and", "or"):
                self.fail("only and, or and ; connect keywords")
            self.at += 1
            if self.head[0] == "end" or self.head[1] == ";":
                self.fail(f"{word} lacks a keyword")
            if not self.head[3]:
                self.fail("only and, or and ; connect keywords")
            if word == "or":
                branches.append([])
                start.append(self.head[2])
            branches[-1].append(self.atom())
        for b, at in zip(branches, start):
            if all(a.negated for a in b):
                raise RuleSyntaxError("each branch needs a keyword that is not negated", at)
        return KeywordRule(tuple(map(tuple, branches)))


def parse_keyword_rules(text: str | None) -> list[KeywordRule]:
    """Rules parted by semicolons; the last semicolon may end the text."""
    r, out = _Keywords(text or ""), []
    while r.head[0] != "end":
        if r.head[1] == ";" and r.head[0] == "mark":
            r.fail("empty rule")
        out.append(r.rule())
        if r.head[0] == "mark":
            r.at += 1
    return out


def first_rule(text: Column, rules: list[KeywordRule]) -> Column:
    """Place (from 0) of the first rule that the comparison text satisfies, null for none."""
    return F.coalesce(*[F.when(r.column(text), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword, stripped, that the comparison text holds."""
    words = [k.strip() for k in keywords if k.strip()]
    return F.coalesce(*[F.when(text.contains(plain(k)), F.lit(k)) for k in words], F.lit(None).cast("string"))


# --- criterion rules: (C001 AND C002) OR C003 ------------------------------------------------------------

_CRITERION = re.compile(r"C[0-9]{3,}")
_WORDS = re.compile(r"\s*(?:([()])|([A-Za-z0-9]+(?![^\s()]))|(\S))")


def criterion_ok(name) -> bool:
    return isinstance(name, str) and bool(_CRITERION.fullmatch(name)) and int(name[1:]) > 0


def parse_criterion_rule(text: str) -> tuple:
    """A tree of ("and" | "or", left, right) over criterion names; AND binds tighter, names and words are case-sensitive."""
    if not isinstance(text, str) or not text.strip():
        raise RuleSyntaxError("empty rule", 0)
    items, at = [], 0
    while text[at:].strip():
        m = _WORDS.match(text, at)
        word = m[1] or m[2]
        if word is None or word not in ("(", ")", "AND", "OR") and not criterion_ok(word):
            raise RuleSyntaxError("unknown word", m.start() + len(m[0]) - len(m[0].lstrip()))
        items.append((word, m.end() - len(word)))
        at = m.end()
    items.append(("", len(text)))
    pos = 0

    def level(word, lower):
        nonlocal pos
        tree = lower()
        while items[pos][0] == word:
            pos += 1
            tree = (word.lower(), tree, lower())
        return tree

    def primary():
        nonlocal pos
        word, where = items[pos]
        pos += 1
        if word == "(":
            tree = any_()
            if items[pos][0] != ")":
                raise RuleSyntaxError("a parenthesis is not closed", items[pos][1])
            pos += 1
            return tree
        if not criterion_ok(word):
            raise RuleSyntaxError("a criterion or group is missing", where)
        return word

    def any_():
        return level("OR", lambda: level("AND", primary))

    tree = any_()
    if items[pos][0]:
        raise RuleSyntaxError("malformed rule", items[pos][1])
    return tree


def criteria_of(tree) -> set[str]:
    return {tree} if isinstance(tree, str) else criteria_of(tree[1]) | criteria_of(tree[2])


def criterion_column(tree, results: Column) -> Column:
    if isinstance(tree, str):
        return results[tree]
    a, b = (criterion_column(t, results) for t in tree[1:])
    return a & b if tree[0] == "and" else a | b


def rule_set(results: Column, rules: list[str]) -> Column:
    """Whether a map of criterion results satisfies any rule; null if a named criterion is missing or a key is no criterion."""
    if not rules:
        raise RuleSyntaxError("no rules", 0)
    trees = [parse_criterion_rule(r) for r in rules]
    names = sorted(set().union(*map(criteria_of, trees)))
    keys = F.map_keys(results)
    whole = F.forall(F.array(*map(F.lit, names)), lambda n: F.array_contains(keys, n) & results[n].isNotNull())
    valid = F.forall(keys, lambda k: k.rlike("^C[0-9]{3,}$") & ~k.rlike("^C0+$"))
    out = F.lit(False)
    for t in trees:
        out = out | criterion_column(t, results)
    return F.when(whole & valid, out)
