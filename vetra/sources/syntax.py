"""Syntax tables of source files: one row for each node that rules look at.

Python goes through the standard parser; languages with braces, and those
whose blocks are words, through lexers that know strings, comments, brackets,
loops, calls, functions, branches and handlers.  R, HCL, Elixir and Erlang are
only checked for matching brackets.  A file that doesn't parse gives one
``error`` row; one without a family gives none.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexer
from .files import extension, family, is_source, masked_frontmatter, masked_script

NODES = (
    "path string, family string, node_id int, parent_id int, last_id int, kind string, name string, argument string, literal boolean, size int, "
    "start_line long, end_line long, loop_depth int, scope_id int, bounded boolean, in_return boolean, text string, branches int, outermost boolean, holds_map boolean"
)
#: Characters of node texts in one frame of the table.
FRAME_TEXT = 1 << 24
#: Bytes of files in one part at most, by the planner's size.
PART_BYTES = 1 << 26
#: How many times the session's shuffle partitions there may be, as the planner's size may be far too large.
PARTS_MORE = 32

#: Calls that run their argument for every element, by family (fixed values).
ITERATION_CALLS = {
    "javascript": {"map", "filter", "forEach"}, "rust": {"for_each"}, "java": {"map", "filter", "forEach"}, "kotlin": {"map", "filter", "forEach"}, "csharp": {"Select", "Where", "ForEach"},
    "cpp": {"for_each"}, "ruby": {"each", "map", "select"}, "php": {"array_map", "array_filter"}, "swift": {"map", "filter", "forEach"}, "dart": {"map", "where", "forEach"},
}
BRACED = {"javascript", "rust", "go", "java", "kotlin", "csharp", "c", "cpp", "php", "swift", "dart", "zig", "scala", "solidity"}
#: Words that open and close blocks; ``modifier`` ones open only at the start of a statement (fixed values).
WORDED = {
    "ruby": {"open": {"def", "class", "module", "begin", "do", "case", "if", "unless", "while", "until", "for"}, "close": {"end"}, "modifier": {"if", "unless", "while", "until"}, "comment": "#", "loop": {"while", "until", "for"}, "branch": {"if", "unless", "while", "until", "for", "when", "rescue"}},
    "lua": {"open": {"function", "if", "for", "while", "repeat", "do"}, "close": {"end", "until"}, "modifier": set(), "comment": "--", "loop": {"for", "while", "repeat"}, "branch": {"if", "elseif", "for", "while", "repeat"}},
    "shell": {"open": {"if", "for", "while", "until", "case", "select"}, "close": {"fi", "done", "esac"}, "modifier": {"if", "for", "while", "until", "case", "select"}, "comment": "#", "loop": {"for", "while", "until"}, "branch": {"if", "elif", "for", "while", "until"}},
}
#: Languages that are only checked for matching brackets, and what begins their comments.
BRACKETED = {"r": "#", "hcl": "#|//", "elixir": "#", "erlang": "%"}


#: Languages whose ``case`` counts as a branch, and those whose conditional expression does (fixed values).
CASES = {"javascript", "c", "cpp", "php"}
CONDITIONALS = {"c", "cpp", "csharp", "php", "dart"}


class Node:
    __slots__ = ("kind", "name", "argument", "literal", "size", "start", "end", "line", "end_line", "bounded", "in_return", "text", "loop")

    def __init__(self, kind, start, end, line, end_line, name="", argument="", literal=True, size=0, bounded=False, in_return=False, text="", loop=False):
        self.kind, self.start, self.end, self.line, self.end_line = kind, start, end, line, end_line
        self.name, self.argument, self.literal, self.size, self.bounded, self.in_return, self.text, self.loop = name, argument, literal, size, bounded, in_return, text, loop


def taken(text: str) -> bool:
    """Whether the first ``.take(`` of a loop's text has a number: its rounds don't grow with the data."""
    found = re.search(r"\.take\(([^)]*)\)", text)
    return bool(found and re.fullmatch(r"[0-9]+", found[1]))


def terminal(name: str) -> str:
    parts = [p for p in re.split(r"[.:>]", name) if p]
    return parts[-1] if parts else ""


# ---- Python ----------------------------------------------------------------------


#: What most of a tree consists of and no rule looks at: with parts that may be looked at, and without.
_PLAIN = {ast.Module, ast.Expr, ast.Attribute, ast.arg, ast.arguments, ast.Compare, ast.Return, ast.keyword, ast.Subscript, ast.BinOp, ast.BoolOp, ast.UnaryOp, ast.Starred}
_DEFINED, _LOOPED, _LISTED, _CHOSEN = (ast.FunctionDef, ast.AsyncFunctionDef), (ast.For, ast.AsyncFor, ast.While), (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp), (ast.If, ast.IfExp, ast.match_case)
_ASSIGNED, _COLLECTED, _IMPORTED = (ast.Assign, ast.AnnAssign, ast.AugAssign), (ast.List, ast.Tuple, ast.Set, ast.Dict), (ast.Import, ast.ImportFrom)
_BARE = {ast.Name, ast.alias, ast.Pass, ast.Break, ast.Continue, *(k for base in (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop) for k in base.__subclasses__())}


def _walked(tree: ast.AST) -> Iterator[tuple[ast.AST, bool]]:
    """Nodes of a tree but for the bare ones, level by level, and whether a return statement is around them."""
    level = [(tree, False)]
    while level:
        below = []
        for n, returned in level:
            returned = returned or type(n) is ast.Return
            yield n, returned
            for field in n._fields:
                part = getattr(n, field, None)
                if type(part) is list:
                    below += [(x, returned) for x in part if isinstance(x, ast.AST) and type(x) not in _BARE]
                elif isinstance(part, ast.AST) and type(part) not in _BARE:
                    below.append((part, returned))
        level = below


def python_nodes(source: str) -> list[Node]:
    tree = ast.parse(source)
    plain = source.isascii()  # a byte is a character
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line if plain else line.encode()))
    raw = source if plain else source.encode()
    out: list[Node] = []

    def text(n: ast.AST) -> str:
        cut = raw[starts[n.lineno - 1] + n.col_offset : starts[n.end_lineno - 1] + n.end_col_offset]
        return cut if plain else cut.decode("utf-8", "replace")

    def add(n: ast.AST, kind: str, **more) -> None:
        out.append(Node(kind, starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset, n.lineno, n.end_lineno, text=text(n), **more))

    for n, returned in _walked(tree):
        if type(n) in _PLAIN:
            continue
        if isinstance(n, ast.Constant):
            if isinstance(n.value, (str, bytes)):
                add(n, "string")
        elif isinstance(n, _DEFINED):
            add(n, "function", name=n.name, argument=",".join(a.arg for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]))
        elif isinstance(n, _LOOPED):
            it = getattr(n, "iter", None)
            fixed = isinstance(it, ast.Call) and terminal(text(it.func)) == "range" and it.args and all(isinstance(a, ast.Constant) and isinstance(a.value, int) for a in it.args)
            add(n, "loop", bounded=bool(fixed) or taken(text(n)), loop=True)
            add(n, "branch")
        elif isinstance(n, _LISTED):
            # its element, conditions and sources all run in it; a comprehension is one loop, however many clauses it has
            add(n, "loop", bounded=taken(text(n)), loop=True)
        elif isinstance(n, _CHOSEN):
            if isinstance(n, ast.match_case):
                n.lineno, n.col_offset, n.end_lineno, n.end_col_offset = n.pattern.lineno, n.pattern.col_offset, n.body[-1].end_lineno, n.body[-1].end_col_offset
            add(n, "branch")
        elif isinstance(n, ast.ExceptHandler):
            add(n, "branch")
            add(n, "handler", size=sum(not isinstance(s, ast.Pass) for s in n.body))
        elif isinstance(n, ast.Call):
            first = n.args[0] if n.args else n.keywords[0].value if n.keywords else None
            add(n, "call", name=text(n.func), argument=text(first) if first is not None else "", literal=first is None or isinstance(first, ast.Constant), size=len(n.args), in_return=returned)
        elif isinstance(n, _ASSIGNED):
            add(n, "assign", name=text(n.targets[0] if isinstance(n, ast.Assign) else n.target), argument=text(n.value) if n.value else "")
        elif isinstance(n, _COLLECTED) and isinstance(getattr(n, "ctx", ast.Load()), ast.Load):
            add(n, "collection", size=len(n.keys if isinstance(n, ast.Dict) else n.elts))
        elif isinstance(n, ast.JoinedStr):
            add(n, "string")
        elif isinstance(n, _IMPORTED):
            add(n, "import")
        elif isinstance(n, ast.Raise):
            add(n, "raise")
    return out


# ---- braces ------------------------------------------------------------------------

#: Languages whose functions begin with a type or a name, words that may stand between their head and body, and statements that look like one (fixed values).
TYPED = {"java", "csharp", "c", "cpp", "dart"}
_BETWEEN = {"throws", "const", "noexcept", "override", "final", "async", "sync", "mutable", "volatile", "where"}
_STATEMENTS = {"synchronized", "using", "lock", "foreach", "fixed", "try", "sizeof", "typeof", "decltype", "alignas", "when", "assert"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "match", "return", "function", "fn", "func", "loop", "do", "else", "await", "new", "typeof", "in", "of", "import", "super"}


def braced_nodes(source: str, lang: str) -> list[Node]:
    toks = lexer.tokens(source, lang)
    pair, stack = {}, []
    for i, (kind, t, *_) in enumerate(toks):
        if kind == "mark" and t in _OPEN:
            stack.append(i)
        elif kind == "mark" and t in _CLOSE:
            if not stack or toks[stack[-1]][1] != _CLOSE[t]:
                raise SyntaxError("brackets don't match")
            pair[stack.pop()] = i
    if stack:
        raise SyntaxError("brackets don't match")
    opener = {j: i for i, j in pair.items()}
    out: list[Node] = []
    n = len(toks)

    def node(kind: str, i: int, j: int, **more) -> Node:
        j = min(j, n - 1)
        text = source[toks[i][2] : toks[j][3]]
        x = Node(kind, toks[i][2], toks[j][3], toks[i][4], toks[j][4] + toks[j][1].count("\n"), text=text, **more)
        out.append(x)
        return x

    def body_end(i: int) -> int:
        """Last token of the statement whose head starts at i: its block, or up to a semicolon."""
        j = i + 1
        while j < n:
            t = toks[j][1]
            if t == "{":
                return pair[j]
            if t in "([" and toks[j][0] == "mark":
                j = pair[j]
            elif t == ";" or t in ")]}":
                return j - (t != ";")
            j += 1
        return n - 1

    def statement_end(i: int) -> int:
        j = i
        while j < n and not (toks[j][0] == "mark" and toks[j][1] in ";)]}"):
            j = pair[j] + 1 if j in pair else j + 1
            if j < n and toks[j][4] > toks[j - 1][4] and toks[j][0] == "word":
                break
        return max(i, min(j, n) - 1)

    for i, (kind, t, *_) in enumerate(toks):
        before = toks[i - 1][1] if i else ""
        after = toks[i + 1][1] if i + 1 < n else ""
        if kind == "string":
            node("string", i, i)
        elif kind == "word" and before != ".":
            if t in ("for", "while", "loop", "foreach") and after != ":":
                end = body_end(i)
                if t == "while" and before == "}" and toks[opener[i - 1] - 1][1] in ("do", "repeat"):
                    continue  # the end of another loop
                node("loop", i, end, loop=True, bounded=taken(source[toks[i][2] : toks[end][3]]))
                node("branch", i, end)
            elif t == "do" and after == "{" or t == "repeat" and lang == "swift" and after == "{":
                node("loop", i, pair[i + 1], loop=True, bounded=taken(source[toks[i][2] : toks[pair[i + 1]][3]]))
                node("branch", i, pair[i + 1])
            elif t == "if" or t == "case" and lang in CASES:
                node("branch", i, body_end(i))
            elif t == "catch":
                end = body_end(i)
                block = next((k for k in range(i, end) if toks[k][1] == "{"), end)
                node("branch", i, end)
                node("handler", i, end, size=sum(x[1] != ";" for x in toks[block + 1 : end]))
            elif t in ("function", "fn", "func", "fun", "def"):
                k = i + 1
                if after == "(" and t == "func":
                    k = pair[i + 1] + 1
                if k < n and toks[k][1] == "*":
                    k += 1
                if k + 1 < n and toks[k][0] == "word":
                    p = next((q for q in range(k + 1, min(k + 40, n)) if toks[q][1] == "("), None)
                    if p is not None:
                        inside = source[toks[p][3] : toks[pair[p]][2]]
                        args = ",".join(m[0] for part in inside.split(",") if (m := re.search(r"[A-Za-z_$][\w$]*", part.replace("mut ", ""))))
                        node("function", i, body_end(pair[p]), name=toks[k][1], argument=args)
            elif t in ("import", "use", "require", "package"):
                node("import", i, statement_end(i))
            elif t in ("throw", "raise"):
                node("raise", i, statement_end(i))
            if t not in _NO_CALL:
                j = i
                while j + 2 < n and toks[j + 1][1] in (".", "::", "->", "?.") and toks[j + 2][0] == "word":
                    j += 2
                if j + 1 < n and toks[j + 1][1] == "(" and toks[j][1] not in _NO_CALL and before not in ("function", "fn", "func", "fun", "def", "new", "::", "->", "?."):
                    close = pair[j + 1]
                    name = source[toks[i][2] : toks[j][3]]
                    block = close + 1 < n and toks[close + 1][1] == "{" and lang == "javascript" and before in ("{", "}", ";", "async", "static")
                    body = _typed_body(toks, close, n) if lang in TYPED and toks[j][1] not in _STATEMENTS and before not in ("=", "return", "(", ",", ".", "=>", "?") else None
                    if body is not None:
                        inside = source[toks[j + 1][3] : toks[close][2]]
                        names = [re.findall(r"[A-Za-z_$][\w$]*", part.split("=")[0]) for part in inside.split(",")]
                        node("function", i, pair[body], name=toks[j][1], argument=",".join(x[-1] for x in names if x))
                    elif block:
                        inside = source[toks[j + 1][3] : toks[close][2]]
                        node("function", i, pair[close + 1], name=name, argument=",".join(re.findall(r"[A-Za-z_$][\w$]*", inside)))
                    else:
                        _call(node, toks, pair, source, i, j + 1, close, name, lang)
                if j + 1 < n and toks[j + 1][1] in ("=", ":=") and before not in (".", "::"):
                    end = statement_end(j + 2) if j + 2 < n else j + 1
                    node("assign", i, end, name=source[toks[i][2] : toks[j][3]], argument=source[toks[j + 1][3] : toks[end][3]].strip())
        elif kind == "mark" and t == "." and i and (before in (")", "]") or toks[i - 1][0] == "string") and i + 2 < n and toks[i + 1][0] == "word":
            j = i + 1
            while j + 2 < n and toks[j + 1][1] == "." and toks[j + 2][0] == "word":
                j += 2
            if j + 1 < n and toks[j + 1][1] == "(":
                _call(node, toks, pair, source, i + 1, j + 1, pair[j + 1], source[toks[i + 1][2] : toks[j][3]], lang)
        elif kind == "mark" and t == "?" and lang in CONDITIONALS and before not in ("(", "[", "{", ",", ";"):
            k = i + 1
            while k < n and toks[k][1] not in (":", ";", ",", ")", "]", "}"):
                k = pair.get(k, k) + 1
            if k < n and toks[k][1] == ":" and k > i + 1:
                node("branch", i - 1, k)
        elif kind == "mark" and t == "=>" and lang == "rust":
            node("branch", max(0, i - 1), i)
        elif kind == "mark" and t in "[{" and before in ("=", "(", ",", ":", "return", "["):
            parts, k = 0, i + 1
            while k < pair[i]:
                parts += 1
                while k < pair[i] and toks[k][1] != ",":
                    k = pair.get(k, k) + 1
                k += 1
            node("collection", i, pair[i], size=parts)
    return out


def _typed_body(toks: list[tuple], close: int, n: int) -> int | None:
    """The bracket that opens a function's body after its head, or None if that is no head."""
    k = close + 1
    if k < n and toks[k][1] in _BETWEEN:
        while k < n and (toks[k][0] == "word" or toks[k][1] in (",", ".", "<", ">")):
            k += 1
    return k if k < n and toks[k][1] == "{" else None


def _call(node, toks, pair, source: str, i: int, open_: int, close: int, name: str, lang: str) -> None:
    first, k = "", open_ + 1
    while k < close and toks[k][1] != ",":
        k = pair.get(k, k) + 1
    first = source[toks[open_ + 1][2] : toks[k - 1][3]] if k > open_ + 1 else ""
    single = k == open_ + 2 and toks[open_ + 1][0] in ("string", "number") and "${" not in first
    line_head = source.rfind("\n", 0, toks[i][2]) + 1
    returned = source[line_head : toks[i][2]].lstrip().startswith("return")
    node("call", i, close, name=name, argument=first, literal=single or not first, loop=terminal(name) in ITERATION_CALLS.get(lang, ()), in_return=returned, size=0 if not first else 1)


# ---- words --------------------------------------------------------------------------


def _plain_tokens(source: str, comment: str) -> list[tuple]:
    """(kind, text, start, end, line), without space and comments; a line break is a token."""
    pattern = re.compile(
        rf"(?P<comment>(?:{comment})[^\n]*)|(?P<string>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\[\[.*?\]\])|(?P<heredoc><<[-~]?['\"]?(?P<tag>[A-Z_]+)['\"]?[^\n]*\n.*?^[ \t]*(?P=tag)$)"
        r"|(?P<number>\d[\w.]*)|(?P<word>[$@]{0,2}[A-Za-z_]\w*[?!]?)|(?P<space>[ \t\r]+)|(?P<mark>[=!<>]=|->|::|&&|\|\||.|\n)",
        re.S | re.M,
    )
    out, line = [], 1
    for m in pattern.finditer(source):
        kind = "heredoc" if m["heredoc"] else m.lastgroup
        if kind not in ("space", "comment"):
            out.append((kind, m[0], m.start(), m.end(), line))
        line += m[0].count("\n")
    return out


def bracketed(source: str, comment: str, char: str = "") -> None:
    """Raises SyntaxError unless all brackets outside strings and comments match."""
    stack = []
    for kind, t, *_ in _plain_tokens(re.sub(char, " ", source) if char else source, comment):
        if kind == "mark" and t in _OPEN:
            stack.append(t)
        elif kind == "mark" and t in _CLOSE:
            if not stack or stack.pop() != _CLOSE[t]:
                raise SyntaxError("brackets don't match")
    if stack:
        raise SyntaxError("brackets don't match")


def worded_nodes(source: str, lang: str) -> list[Node]:
    """Nodes of languages whose blocks begin and end with words."""
    words = WORDED[lang]
    toks = _plain_tokens(source, words["comment"])
    out: list[Node] = []
    n = len(toks)

    def node(kind: str, i: int, j: int, **more) -> None:
        out.append(Node(kind, toks[i][2], toks[j][3], toks[i][4], toks[j][4] + toks[j][1].count("\n"), text=source[toks[i][2] : toks[j][3]], **more))

    stack: list[tuple[str, int]] = []
    ends: dict[int, int] = {}
    pending = False  # a loop's own ``do``
    for i, (kind, t, *_) in enumerate(toks):
        first = i == 0 or toks[i - 1][1] in ("\n", ";", "then", "do", "else", "=", "(", "{", "&&", "||")
        if t == "\n":
            pending = False
        if kind == "word" and t in words["open"] and (i == 0 or toks[i - 1][1] not in (".", "::", ":")):
            if t == "do" and pending:
                pending = False
            elif t not in words["modifier"] or first:
                stack.append((t, i))
                pending = t in ("while", "until", "for") and lang != "shell"
        elif kind == "word" and t in words["close"] and (lang != "shell" or first or toks[i - 1][1] in ("\n", ";")) and (i == 0 or toks[i - 1][1] != "."):
            if t == "until" and (not stack or stack[-1][0] != "repeat"):
                continue
            if not stack:
                raise SyntaxError("blocks don't match")
            ends[stack.pop()[1]] = i
        elif kind == "mark" and t in "([{":
            if lang != "shell":
                stack.append((t, i))
        elif kind == "mark" and t in ")]}" and lang != "shell":
            if not stack or stack[-1][0] != _CLOSE[t]:
                raise SyntaxError("brackets don't match")
            ends[stack.pop()[1]] = i
    if stack:
        raise SyntaxError("blocks don't match")
    line_end = lambda i: next((j - 1 for j in range(i + 1, n) if toks[j][1] in ("\n", ";")), n - 1)
    braces: list[int] = []
    for i, (kind, t, *_) in enumerate(toks):
        before = toks[i - 1][1] if i else "\n"
        if kind in ("string", "heredoc"):
            node("string", i, i)
        elif kind == "mark" and lang == "shell" and t == "{":
            braces.append(i)
        elif kind == "mark" and lang == "shell" and t == "}" and braces:
            ends[braces.pop()] = i
        elif kind == "word":
            if i in ends:
                if t in words["loop"]:
                    node("loop", i, ends[i], loop=True)
                if t in ("def", "function"):
                    k = i + 1 + 2 * (i + 3 < n and toks[i + 2][1] in (".", ":"))
                    if k < n and toks[k][0] == "word":
                        inside = source[toks[k + 1][3] : toks[ends[k + 1]][2]] if k + 1 in ends else ""
                        node("function", i, ends[i], name=toks[k][1], argument=",".join(re.findall(r"[A-Za-z_]\w*", inside)))
            if t in words["branch"]:
                node("branch", i, ends.get(i, line_end(i)))
            if t == "rescue":
                stop = next((j for j in range(i + 1, n) if toks[j][1] in ("end", "ensure", "else", "rescue")), n - 1)
                node("handler", i, stop, size=sum(x[1] != "\n" for x in toks[line_end(i) + 1 : stop]))
            if t in ("require", "require_relative", "source", "import") and before in ("\n", ";", "="):
                node("import", i, line_end(i))
            elif t == "raise":
                node("raise", i, line_end(i))
            elif before not in ("def", "function", ".", ":", "::") and t not in words["open"] | words["close"]:
                j = i
                while j + 2 < n and toks[j + 1][1] in (".", ":", "::") and toks[j + 2][0] == "word":
                    j += 2
                close = ends.get(j + 1) if j + 1 < n and toks[j + 1][1] == "(" else None
                if close is not None:
                    stop = next((k for k in range(j + 2, close) if toks[k][1] == ","), close)
                    first = source[toks[j + 2][2] : toks[stop - 1][3]] if stop > j + 2 else ""
                    single = stop == close == j + 3 and toks[j + 2][0] in ("string", "number")
                    name = source[toks[i][2] : toks[j][3]]
                    node("call", i, close, name=name, argument=first, literal=single or not first, loop=terminal(name) in ITERATION_CALLS.get(lang, ()), size=0 if not first else 1, in_return=before == "return")
                elif lang == "ruby" and j > i and j + 1 < n and toks[j + 1][1] in ("do", "{") and terminal(source[toks[i][2] : toks[j][3]]) in ITERATION_CALLS["ruby"]:
                    stop = ends.get(j + 1, line_end(j))
                    node("call", i, stop, name=source[toks[i][2] : toks[j][3]], argument="", literal=False, loop=True, size=1)
            if i + 1 < n and toks[i + 1][1] == "=" and before in ("\n", ";", "local", "then", "do"):
                stop = line_end(i)
                node("assign", i, stop, name=t, argument=source[toks[i + 1][3] : toks[stop][3]].strip())
            if lang == "shell" and i + 3 < n and [x[1] for x in toks[i + 1 : i + 3]] == ["(", ")"]:
                k = next((k for k in range(i + 3, min(n, i + 6)) if toks[k][1] == "{"), None)
                if k is not None:
                    depth, j = 0, k
                    while j < n:
                        depth += (toks[j][1] == "{") - (toks[j][1] == "}")
                        if not depth:
                            break
                        j += 1
                    node("function", i, min(j, n - 1), name=t)
    return out


# ---- tables ------------------------------------------------------------------------


def table_rows(path: str, lang: str, source: str) -> list[tuple]:
    try:
        if lang == "python":
            nodes = python_nodes(source)
        elif lang in BRACED:
            nodes = braced_nodes(source, lang)
        elif lang in WORDED:
            nodes = worded_nodes(source, lang)
        elif lang in BRACKETED:
            bracketed(source, BRACKETED[lang], r"\$." if lang == "erlang" else "")
            nodes = []
        else:
            raise SyntaxError("no backend")
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, lang, 0, None, 0, "error", "", str(e)[:240], True, 0, 1, 1, 0, None, False, False, "", 0, True, False)]
    nodes.sort(key=lambda x: (x.start, -x.end, not x.loop))
    rows, stack = [], []
    for i, x in enumerate(nodes):
        while stack and nodes[stack[-1]].end <= x.start:
            stack.pop()
        parent, depth, scope, outermost = stack[-1] if stack else None, 0, None, True
        for s in stack:
            y = nodes[s]
            if y.loop and not (y.start == x.start and y.end == x.end):
                depth += 1
            if y.kind == "function":
                scope = s
            if y.kind == x.kind:
                outermost = False
        rows.append([path, lang, i, parent, i, x.kind, x.name, x.argument, x.literal, x.size, x.line, x.end_line, depth, scope, x.bounded, x.in_return, x.text, 0, outermost, False])
        maps = x.kind == "call" and terminal(x.name) == "map"
        for s in stack:
            rows[s][4] = i
            rows[s][19] |= maps
        if x.kind == "branch" and scope is not None:
            rows[scope][17] += 1
        stack.append(i)
    return [tuple(r) for r in rows]


#: Files whose scripts are JavaScript among other text (fixed values).
COMPONENTS = (".vue", ".svelte", ".astro")


def spread(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows (path, content, ...) dealt out for Python: parsing costs far more than a table's bytes tell, and a small file of rows is one task.

    The number of parts is given, as few bytes would else be put together again:
    the session's shuffle partitions, or one for each PART_BYTES by the planner's
    size of ``files`` (the rows themselves; its size of a join is a product).
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = int((rows if files is None else files)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(least, min(planned // PART_BYTES, least * PARTS_MORE)), "path", "content")


def analysed(files: DataFrame) -> DataFrame:
    """(path, family, content) of the files that have a family, with all but the scripts of component files blanked."""
    path = F.col("path")
    ext = extension(path)
    component = F.coalesce(ext.isin([c[1:] for c in COMPONENTS]), F.lit(False))
    kind = F.when(component, "javascript").otherwise(family(path))
    script = F.when(ext == "astro", masked_frontmatter(F.col("content"))).otherwise(masked_script(F.col("content")))
    rows = files.where(is_source(path)).select("path", kind.alias("family"), F.when(component, script).otherwise(F.col("content")).alias("content"))
    return rows.where("family IS NOT NULL")


def nodes(files: DataFrame, dealt: bool = False) -> DataFrame:
    """The node table of (path, content): parse once, use for all rules; ``dealt`` files are in many parts already.

    ``last_id`` closes the interval of a node's descendants, ``loop_depth``
    counts the loops and iteration calls around it, ``scope_id`` is its function.
    ``branches`` are a function's own, ``outermost`` says that no node around it is
    of its kind, ``holds_map`` that a call named map is inside.
    ``text`` and ``argument`` are whole, as rules judge them: a file's rows have
    its text once for each level of nesting.
    """
    names = [f.split()[0] for f in NODES.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"parent_id": "Int32", "scope_id": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for path, lang, text in zip(pdf["path"], pdf["family"], pdf["content"]):
                for r in table_rows(path, lang, text or ""):
                    if r[5] == "error" and path.endswith(COMPONENTS):
                        continue  # what stands in a component file may be no whole script
                    out.append(r)
                    size += len(r[7]) + len(r[16])
                    if size >= FRAME_TEXT:
                        yield frame(out)
                        out, size = [], 0
            yield frame(out)

    rows = analysed(files)
    return (rows if dealt else spread(rows)).mapInPandas(run, NODES)
