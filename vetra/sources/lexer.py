"""Tokens of languages with braces: a stack of modes, code over text over code, as strings may hold code.

A mode of text ends at its closing mark; what opens an interpolation puts a mode
of code on the stack, which ends at its own bracket.  So brackets, quotes and
comment marks count only where the language reads them as such.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple


class Text(NamedTuple):
    """A kind of string: how it opens, closes (``{0}`` is the opening's first group, quoted), what it holds."""

    opens: str
    closes: str
    escape: str = r"\\."  # what is passed over; empty where a backslash is a character
    lines: bool = False  # may hold line breaks
    code: str = ""  # opens an interpolation, closed by the bracket that matches its last character


_DOUBLE, _SINGLE = Text('"', '"'), Text("'", "'")
_CHAR = Text(r"'(?=(?:[^'\\\n]|\\[^\n][^'\n]{0,8})')", "'")
_TRIPLE = Text('"""', '"""', lines=True)

#: The strings of each language, longer openings first (fixed values of the languages).
STRINGS: dict[str, list[Text]] = {
    "javascript": [_DOUBLE, _SINGLE, Text("`", "`", lines=True, code=r"\$\{")],
    "rust": [Text(r'(?:b|c)?r(#*)"', '"{0}', "", True), Text(r'[bc]?"', '"', lines=True), Text(r"b?" + _CHAR.opens, "'")],
    "go": [Text("`", "`", "", True), _DOUBLE, _CHAR],
    "java": [_TRIPLE, _DOUBLE, _CHAR],
    "kotlin": [Text('"""', '"""(?!")', "", True, r"\$\{"), Text('"', '"', code=r"\$\{"), _CHAR],
    "scala": [Text('[A-Za-z_]\\w*"""', '"""(?!")', r"\$\$", True, r"\$\{"), Text('"""', '"""(?!")', "", True), Text('[A-Za-z_]\\w*"', '"', code=r"\$\{"), _DOUBLE, _CHAR],
    "csharp": [
        Text(r'\$+"("{2,})', '"{0}', "", True, r"\{"), Text(r'"("{2,})', '"{0}', "", True), Text(r'(?:\$@|@\$)"', '"(?!")', r'""|\{\{', True, r"\{(?!\{)"), Text('@"', '"(?!")', '""', True),
        Text(r'\$"', '"', r"\\.|\{\{", False, r"\{(?!\{)"), _DOUBLE, _CHAR,
    ],
    "c": [Text('(?:u8|[uUL])?"', '"'), Text("(?:u8|[uUL])?'", "'")],
    "cpp": [Text(r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(', r'\){0}"', "", True), Text('(?:u8|[uUL])?"', '"'), Text("(?:u8|[uUL])?'", "'")],
    "php": [Text(r"<<<[ \t]*'([A-Za-z_]\w*)'[ \t]*\n", r"^[ \t]*{0}\b", "", True), Text(r'<<<[ \t]*"?([A-Za-z_]\w*)"?[ \t]*\n', r"^[ \t]*{0}\b", lines=True, code=r"\{(?=\$)"), Text('"', '"', lines=True, code=r"\{(?=\$)"), Text("'", "'", lines=True), Text("`", "`", lines=True)],
    "swift": [Text(r'(#+)"""', '"""{0}', "", True), Text('"""', '"""', lines=True, code=r"\\\("), Text(r'(#+)"', '"{0}', "", False), Text('"', '"', code=r"\\\(")],
    "dart": [Text("r'''", "'''", "", True), Text('r"""', '"""', "", True), Text("r'", "'", ""), Text('r"', '"', ""), Text("'''", "'''", lines=True, code=r"\$\{"), Text('"""', '"""', lines=True, code=r"\$\{"), Text("'", "'", code=r"\$\{"), Text('"', '"', code=r"\$\{")],
    "zig": [Text(r"\\\\", r"(?=\n)|\Z", "", True), Text('c?"', '"'), _CHAR],
    "solidity": [Text('(?:hex|unicode)?"', '"'), Text("(?:hex|unicode)?'", "'")],
}
#: Languages whose block comments nest, whose lines may be instructions to a preprocessor, and comments to the end of a line beside // (fixed values).
NESTED = {"rust", "swift", "kotlin", "scala", "dart"}
PREPROCESSED = {"c", "cpp", "csharp"}
LINE_COMMENTS = {"php": r"//|\#(?!\[)", "zig": "//"}
#: Words of JavaScript after which a slash begins a pattern, and those whose bracket is followed by a statement (fixed values).
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await"}
_HEADS = {"if", "while", "for", "with"}
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@cache
def _code(lang: str) -> re.Pattern:
    """What begins at a place in code."""
    strings = "|".join(f"(?P<s{i}>{s.opens})" for i, s in enumerate(STRINGS[lang]))
    quotes = r"(?:'\w+)*" if lang in ("c", "cpp") else ""
    line = r"\#(?:\\\r?\n|[^\n])*|" if lang in PREPROCESSED else ""
    rest = r"(?:(?!\?>)[^\n])*" if lang == "php" else r"[^\n]*"
    block = "" if lang == "zig" else r"|(?P<block>/\*)"
    life = r"(?P<life>'[A-Za-z_]\w*)|" if lang in ("rust", "scala") else ""
    return re.compile(
        rf"(?P<comment>{line}(?:{LINE_COMMENTS.get(lang, '//')}){rest}){block}|(?P<strings>{strings})|{life}(?P<number>\d[\w.]*{quotes})|(?P<word>(?:r\#)?[A-Za-z_$][\w$]*!?(?=\()|(?:r\#)?[A-Za-z_$][\w$]*)|(?P<space>\s+)"
        r"|(?P<mark>=>|::|->|:=|\?\.|\?\?|[=!<>]=+|.)",
        re.S | re.M,
    )


@cache
def _inside(lang: str, kind: int, first: str) -> re.Pattern:
    """What ends a piece of text: the end of the string, an interpolation, a line break that it can't hold; what is passed over first."""
    s = STRINGS[lang][kind]
    closes = s.closes.replace("{0}", re.escape(first))
    opens = f"|(?P<code>{s.code})" if s.code else ""
    # an interpolation may begin like an escape, and is looked for first
    skip = f"|(?P<skip>{s.escape})" if s.escape else ""
    return re.compile(f"(?P<ends>{closes}){opens}{skip}" + ("" if s.lines else r"|(?P<break>\n)"), re.S | re.M)


class _Mode:
    __slots__ = ("kind", "first", "at", "piece", "tokens", "depth", "closer")

    def __init__(self, kind, first="", at=0, tokens=0, closer=""):
        self.kind, self.first, self.at, self.piece, self.tokens, self.depth, self.closer = kind, first, at, at, tokens, 0, closer


def _block_end(source: str, at: int, nested: bool) -> int:
    """Where the block comment that begins at ``at`` ends."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" and (nested or not depth) else -1 if m[0] == "*/" else 0
        if not depth:
            return m.end()
    raise SyntaxError("a comment doesn't end")


def _begins_pattern(tokens: list[tuple], heads: list[bool], lang: str) -> bool:
    """Whether a slash after these tokens begins a pattern of JavaScript, and no division."""
    if lang != "javascript":
        return False
    if not tokens:
        return True
    kind, text = tokens[-1][:2]
    if kind == "word":
        return text in _BEFORE_PATTERN
    if text == ")":
        return heads[-1]
    counted = text in "+-" and len(tokens) > 1 and tokens[-2][1] == text and tokens[-2][3] == tokens[-1][2]
    return kind == "mark" and text not in ("]", "}", "<") and not counted


def tokens(source: str, lang: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, line) without space and comments; kinds are string, number, word and mark.

    A string with code in it is a token for each piece of text, with the tokens
    of the code between them in round brackets.  Raises SyntaxError where a
    string or comment doesn't end.  A quote that nothing closes in its line is a mark.
    """
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out: list[tuple] = []
    heads = [False]  # whether the last closed bracket was the head of a statement
    opened: list[bool] = []
    stack = [_Mode(None)]
    code = _code(lang)
    at, size = 0, len(source)
    if lang == "php":
        first = re.search(r"<\?(?:php\b|=)?", source)
        at = first.end() if first else size

    def put(kind: str, start: int, end: int, text: str | None = None) -> None:
        out.append((kind, source[start:end] if text is None else text, start, end, bisect_right(starts, start)))

    while at < size or stack[-1].kind is not None:
        mode = stack[-1]
        if mode.kind is not None:
            m = _inside(lang, mode.kind, mode.first).search(source, at)
            if m is None or m.lastgroup == "break":
                if STRINGS[lang][mode.kind].lines:
                    raise SyntaxError("a string doesn't end")
                # no string after all: its quote is a mark
                del out[mode.tokens :], opened[mode.depth :]
                stack.pop()
                put("mark", mode.at, mode.at + 1)
                at = mode.at + 1
            elif m.lastgroup == "ends":
                put("string", mode.piece, m.end())
                stack.pop()
                at = m.end()
            elif m.lastgroup == "code":
                put("string", mode.piece, m.start())
                put("mark", m.start(), m.end(), "(")
                stack.append(_Mode(None, closer=_OPEN[m["code"][-1]]))
                opened.append(False)
                at = m.end()
            else:
                at = m.end()
            continue
        if lang == "php" and source.startswith("?>", at):
            again = re.compile(r"<\?(?:php\b|=)?").search(source, at)
            put("mark", at, at + 1, ";")
            at = again.end() if again else size
            continue
        m = code.match(source, at)
        kind = m.lastgroup
        if kind == "space" or kind == "comment":
            at = m.end()
            continue
        if kind == "word" or kind == "number":
            end = m.end()
            out.append((kind, source[at:end], at, end, bisect_right(starts, at)))
            at = end
            continue
        if kind == "block":
            at = _block_end(source, at, lang in NESTED)
            continue
        if kind == "strings":
            which = next(i for i in range(len(STRINGS[lang])) if m[f"s{i}"] is not None)
            own = re.compile(STRINGS[lang][which].opens).match(source, at)
            new = _Mode(which, own[1] if own.re.groups else "", at, len(out))
            new.depth = len(opened)
            stack.append(new)
            at = m.end()
            continue
        t = m[0]
        if t == "/" and _begins_pattern(out, heads, lang) and (p := _PATTERN.match(source, at)):
            put("string", at, p.end())
            at = p.end()
            continue
        if t in _OPEN:
            opened.append(t == "(" and bool(out) and out[-1][1] in _HEADS)
            mode.depth += 1
        elif t in _CLOSE:
            if mode.closer and not mode.depth:
                if t != mode.closer:
                    raise SyntaxError("brackets don't match")
                opened.pop()
                stack.pop()
                put("mark", at, m.end(), ")")
                at = m.end()
                stack[-1].piece = at
                continue
            mode.depth -= 1
            heads[-1] = opened.pop() if opened else False
        put("mark", at, m.end(), t)
        at = m.end()
    if len(stack) > 1:
        raise SyntaxError("a string doesn't end")
    return out
