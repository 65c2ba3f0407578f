"""Definitions of JavaScript, TypeScript and Java texts: a token stream with a stack of scopes.

A file and the bodies of classes are scopes of definitions; bodies of functions, other blocks, lists and
groups are not.  Tokens between two ends of a statement make up its head, and a head followed by a
body is a class, a function, a method or none of these.  Nothing is rejected: a closing bracket closes what it
can, unclosed brackets and strings end with the file, and what is between is read on, so a torn file
keeps the definitions that stand in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
_TOKEN = re.compile(
    rf"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<block>\"\"\".*?(?:\"\"\"|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    rf"|(?P<word>\#?{_WORD})|(?P<number>\.?\d[\w.]*)|(?P<other>=>|\.\.\.|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")

# --- fixed values: words of the languages --------------------------------------
MODIFIERS = set("export default async declare abstract public private protected static final readonly override strictfp sealed non-sealed".split())
NO_VALUE = set("return typeof instanceof in of new delete throw case do else yield await".split())
NO_METHOD = set("if for while switch catch return new await typeof super function with synchronized try this throw else do".split())
CLASS_WORDS = {"javascript": {"class"}, "typescript": {"class"}, "tsx": {"class"}, "java": {"class", "interface"}}


@dataclass
class _Token:
    kind: str
    text: str
    line: int
    fresh: bool  # the first of its line


@dataclass
class _Scope:
    kind: str  # file, class, body, block, group
    opener: str = ""
    chain: list[str] = field(default_factory=list)
    head: list[_Token] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)
    fact: dict | None = None
    goes_on: bool = False  # the statement goes on after it
    angle: int = 0


def _template(text: str, at: int) -> int:
    """End of the template literal that starts at ``at``, with the literals and braces nested in it."""
    depth: list[int] = []  # braces open in each substitution
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif not depth or depth[-1] < 0:
            if c == "`":
                if not depth:
                    return at + 1
                depth.pop()
            elif c == "$" and text[at + 1 : at + 2] == "{":
                depth.append(0)
                at += 1
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            depth[-1] -= 1
            if depth[-1] < 0:
                depth.pop()
        elif c == "`":
            depth.append(-1)
        at += 1
    return len(text)


def tokens(language: str, text: str) -> Iterator[_Token]:
    """Words, numbers, literals (as ``value``) and marks, without white space and comments."""
    at, line, fresh, last = 0, 0, True, None
    script = language != "java"
    while at < len(text):
        start = at
        if script and text[at] == "`":
            at, kind = _template(text, at), "value"
        elif script and text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and not _is_value(last) and (m := _REGEX.match(text, at)):
            at, kind = m.end(), "value"
        else:
            m = _TOKEN.match(text, at)
            at, kind = m.end(), m.lastgroup
            if kind == "block" and script:
                m = re.compile(r'"(?:\\.|[^"\\\n])*"').match(text, start)
                at, kind = m.end(), "string"
        own = text[start:at]
        if kind != "skip":
            last = _Token("value" if kind in ("string", "block", "number", "value") else kind, own, line, fresh)
            fresh = False
            yield last
        if "\n" in own:
            line += own.count("\n")
            fresh = True


def _is_value(token: _Token | None) -> bool:
    if token is None:
        return False
    return token.kind in ("value", "group") or token.text in (")", "]", "}") or token.kind == "word" and token.text not in NO_VALUE


def definitions(language: str, text: str) -> Iterator[dict]:
    """``kind`` (class or function), ``name``, ``chain``, ``start``, ``end`` (lines from 0) and ``base``, in the order of their heads."""
    found: list[dict] = []
    stack = [_Scope("file")]
    words = CLASS_WORDS[language]
    line = 0
    for token in tokens(language, text):
        line = token.line
        scope = stack[-1]
        if token.text in "{([" and token.kind == "other":
            stack.append(_opened(scope, token, language, words, found))
        elif token.text in "})]" and token.kind == "other":
            _close(stack, token)
        elif scope.kind in ("file", "class"):
            _step(scope, token, language, found)
    last = max(line, text.count("\n") - text.endswith("\n"))
    for scope in stack:
        if scope.fact:
            scope.fact["end"] = last
    yield from found


def _step(scope: _Scope, token: _Token, language: str, found: list[dict]) -> None:
    """One token more of a statement's head."""
    head = scope.head
    if token.text == ";":
        if scope.kind == "class" and language == "java" and (method := _method(head, language, scope)):
            found.append(_fact("function", method.text, scope, head[0].line, token.line))
        scope.head, scope.angle = [], 0
        return
    if head and token.fresh and language != "java" and _is_value(head[-1]) and not _pending(head, token):
        # a statement that ends with its line
        scope.head = head = []
        scope.angle = 0
    if _names_class(head):
        scope.angle += (token.text == "<") - (token.text == ">" and scope.angle > 0)
    head.append(token)


def _pending(head: list[_Token], token: _Token) -> bool:
    """Does a head go on in the line of ``token``?"""
    if token.kind == "value" or token.kind == "other" and token.text not in "@#*":
        return True
    if token.text in ("extends", "implements", "throws", "is", "as", "instanceof", "in", "of"):
        return True
    words = [t.text for t in head if t.kind == "word"]
    return bool(words) and (all(w in MODIFIERS or w in ("get", "set", "class", "interface", "function") for w in words) or _names_class(head) or _after_decorator(head))


def _after_decorator(head: list[_Token]) -> bool:
    """Are decorators all there is of a head?"""
    return not _plain(head)


def _names_class(head: list[_Token]) -> bool:
    return any(t.text in ("class", "interface") and t.kind == "word" for t in head) and not any(t.text in ("=", ".", "return") for t in head[:3])


def _plain(head: list[_Token]) -> list[_Token]:
    """A head without decorators: ``@`` with a dotted name, and the group that follows it."""
    out, at = [], 0
    while at < len(head):
        if head[at].text == "@" and at + 1 < len(head) and head[at + 1].text != "interface":
            at += 2
            while at + 1 < len(head) and head[at].text == ".":
                at += 2
            if at < len(head) and head[at].text == "()":
                at += 1
            continue
        out.append(head[at])
        at += 1
    return out


def _bare(head: list[_Token]) -> list[_Token]:
    """A head without decorators and modifiers."""
    own = _plain(head)
    while own and own[0].text in MODIFIERS:
        own = own[1:]
    return own


def _opened(scope: _Scope, token: _Token, language: str, words: set[str], found: list[dict]) -> _Scope:
    """The scope that a bracket opens."""
    if token.text != "{" or scope.kind not in ("file", "class"):
        return _Scope("group" if token.text != "{" else "block", token.text, goes_on=True)
    head, own = scope.head, _bare(scope.head)
    last = head[-1].text if head else ""
    if head and token.fresh and language != "java" and own and own[0].text not in (*words, "function") and not any(t.text == "()" for t in own) and _is_value(head[-1]):
        scope.head, head, own = [], [], []
    if scope.angle or head and (last in (":", "|", "&", "<", ",", "=", "?", "(", "=>", "return") or own and own[0].text in ("import", "type")):
        return _Scope("block", "{", goes_on=True)
    if len(own) > 1 and own[0].text in words and own[1].kind == "word":
        base = _base(own) if own[0].text == "class" else None
        fact = _fact("class", own[1].text, scope, own[0].line if language != "java" else head[0].line, None, base)
        if own[0] is not head[0] and language != "java":
            fact["start"] = own[0].line
        found.append(fact)
        return _Scope("class", "{", [*scope.chain, own[1].text], fact=fact)
    if language != "java" and own and own[0].text == "function":
        named = [t for t in own[1:3] if t.kind == "word"]
        if named and any(t.text == "()" for t in own):
            start = next((t for t in head if t.text == "async"), own[0])
            found.append(fact := _fact("function", named[0].text, scope, start.line, None))
            return _Scope("body", "{", fact=fact)
    if scope.kind == "class" and (method := _method(head, language, scope)):
        start = head[0].line if language == "java" else _plain(head)[0].line
        found.append(fact := _fact("function", method.text, scope, start, None))
        return _Scope("body", "{", fact=fact)
    return _Scope("block", "{", goes_on=any(t.text == "=" for t in head))


def _base(head: list[_Token]) -> str | None:
    """The dotted name after the ``extends`` that stands outside of type parameters."""
    depth, name = 0, None
    for token in head:
        depth += (token.text == "<") - (token.text == ">")
        if name is not None:
            if token.kind != "word" and token.text != ".":
                break
            if token.text == "implements":
                break
            name += token.text
        elif not depth and token.text == "extends":
            name = ""
    return name or None


def _method(head: list[_Token], language: str, scope: _Scope) -> _Token | None:
    """The name of the method whose head this is: the word before its first group."""
    own = _plain(head)
    group = next((i for i, t in enumerate(own) if t.text == "()"), 0)
    if not group or any(t.text == "=" for t in own[:group]):
        return None
    at = group - 1
    if own[at].text == ">":  # type parameters of the method
        depth = 0
        while at >= 0:
            depth += (own[at].text == ">") - (own[at].text == "<")
            at -= 1
            if not depth:
                break
    name = own[at] if at >= 0 else None
    if name is None or name.kind != "word" or name.text in NO_METHOD:
        return None
    if language == "java":
        before = [t for t in own[:at] if t.text not in MODIFIERS]
        return name if any(t.kind == "word" for t in before) else None  # a constructor has no type
    return name


def _fact(kind: str, name: str, scope: _Scope, start: int, end: int | None, base: str | None = None) -> dict:
    fact = {"kind": kind, "name": name, "shown": name, "chain": list(scope.chain), "start": start, "end": end, "base": base}
    if kind == "function":
        scope.seen[name] = again = scope.seen.get(name, 0) + 1
        fact["shown"] = name if again == 1 else f"{name}__{again}"
    return fact


_PAIR = {"}": "{", ")": "(", "]": "["}


def _close(stack: list[_Scope], token: _Token) -> None:
    """A closing bracket: a brace closes the last open brace and what is open in it, others only their own."""
    opener = _PAIR[token.text]
    if token.text == "}":
        place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].opener == "{"), None)
    else:
        place = len(stack) - 1 if stack[-1].opener == opener else None
    if not place:
        return
    closed = stack[place]
    del stack[place:]
    if closed.fact:
        closed.fact["end"] = token.line
    outer = stack[-1]
    if outer.kind not in ("file", "class"):
        return
    if closed.goes_on:
        mark = {"(": "()", "[": "[]", "{": "{}"}[closed.opener]
        outer.head.append(_Token("group" if mark == "()" else "value", mark, token.line, False))
    else:
        outer.head, outer.angle = [], 0


__all__ = ["definitions", "tokens"]
