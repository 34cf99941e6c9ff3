"""Outlines of code from masked text: definitions by pattern, extents by brackets, ``end`` or indentation.

There are no grammars here.  Where a parser is at hand (Python) it is used; elsewhere a definition is a
statement that looks like one, in a place where one can stand (the top level or a type's body).  A function's
inside is passed over, so functions in functions are no symbols.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from lodestar.operators.lexer import mask
from lodestar.operators.symbols import CALLABLE, LABEL_LIMIT, Symbol, clip, lines_of, squash

_ID = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|open|virtual|sealed|async|export|default|declare|readonly|partial|unsafe|extern|inline|suspend|data|inner|companion|lateinit|const|synchronized|native|transient|volatile|mutating|nonmutating|fileprivate|indirect|required|convenience|implicit|lazy|case|new|get|set|operator|infix|tailrec|actual|expect|strictfp|default|value|annotation|constexpr|explicit|friend|template\s*<[^>]*>|@[\w.]+(?:\([^()]*\))?)\s+)*"
#: Containers, whose bodies hold further symbols.
HOLDERS = ("class", "struct", "interface", "trait", "enum", "impl", "module", "object")


def _p(kind: str, pattern: str) -> tuple[str, re.Pattern]:
    return kind, re.compile(pattern)


_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_JS = [
    _p("class", rf"{_MODS}class\s+(?P<name>{_ID})"),
    _p("interface", rf"{_MODS}interface\s+(?P<name>{_ID})"),
    _p("enum", rf"{_MODS}enum\s+(?P<name>{_ID})"),
    _p("type", rf"{_MODS}type\s+(?P<name>{_ID})[^=;{{]*="),
    _p("module", rf"{_MODS}(?:namespace|module)\s+(?P<name>[\w.$]+)\s*(?=\{{)"),
    _p("function", rf"{_MODS}function\b\s*\*?\s*(?P<name>{_ID})"),
    _p("function", rf"{_MODS}(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;]+)?=\s*(?:[\w.]+\s*(?:<[^;{{}}()]*>)?\(\s*)?(?:async\s+)?(?:function\b|\([^;{{}}]*\)\s*(?::[^=;{{}}]+)?=>|{_ID}\s*=>)"),
    _p("test", r"(?P<name>(?:describe|it|test|suite|context)(?:\.\w+)?)\s*\("),
]
_JS_MEMBER = [
    _p("constructor", r"(?P<name>constructor)\s*\("),
    _p("method", rf"{_MODS}\*?#?(?P<name>(?!(?:if|for|while|switch|return|catch|function|new)\b){_ID})\??\s*(?:<[^>()]*>)?\s*\("),
    _p("method", rf"{_MODS}#?(?P<name>{_ID})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:\([^;{{}}]*\)\s*(?::[^=;{{}}]+)?=>|{_ID}\s*=>|function\b)"),
]
_NOT_CALL = r"(?!(?:if|for|while|switch|return|catch|else|do|new|throw|using|lock|foreach|sizeof|await|case|goto|typeof|defined|delete|yield|assert|synchronized|with)\b)"
_TYPED = rf"{_MODS}(?:[\w$][\w$.:]*(?:\s*<[^;(){{}}=]*>)?[\w\s*&\[\]?]*?[\s*&\]>]+)"
_JAVA = [
    _p("interface", rf"{_MODS}@?interface\s+(?P<name>{_ID})"),
    _p("enum", rf"{_MODS}enum\s+(?:class\s+)?(?P<name>{_ID})"),
    _p("class", rf"{_MODS}(?:class|record)\s+(?P<name>{_ID})"),
]
_JAVA_MEMBER = [
    _p("method", rf"{_NOT_CALL}(?:{_MODS}<[^>]*>\s*)?{_TYPED}(?P<name>{_NOT_CALL}{_ID})\s*\("),
    _p("constructor", rf"{_MODS}(?P<name>{_NOT_CALL}{_ID})\s*\("),
]
_C = [
    _p("module", r"(?:inline\s+)?namespace\s+(?P<name>[\w:]+)\s*(?=\{)"),
    _p("class", rf"(?:template\s*<[^;{{}}]*>\s*)?class\s+(?:\[\[[^\]]*\]\]\s*)?(?P<name>{_ID})[^;(]*(?=\{{)"),
    _p("macro", r"#\s*define\s+(?P<name>\w+)\([^)]*\)(?:[^\n]*\\\n)*[^\n]*"),
    _p("struct", r"typedef\s+(?:struct|union)\s*(?=\{)"),
    _p("struct", rf"(?:template\s*<[^;{{}}]*>\s*)?(?:typedef\s+)?(?:struct|union)\s+(?P<name>{_ID})[^;()]*(?=\{{)"),
    _p("enum", rf"(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(?P<name>{_ID})[^;()]*(?=\{{)"),
    _p("type", rf"typedef\b[^;{{}}]*?(?P<name>{_ID})\s*(?=;)"),
    _p("function", rf"{_NOT_CALL}(?:template\s*<[^;{{}}]*>\s*)?{_TYPED}(?P<name>(?:[\w~]+(?:<[^<>]*>)?::)*{_NOT_CALL}~?{_ID})\s*\("),
    _p("function", rf"(?P<name>(?:\w+::)+~?{_ID})\s*\("),
]
PATTERNS: dict[str, tuple[list, list]] = {
    "rust": (
        r := [
            _p("function", rf"{_VIS}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>{_ID})"),
            _p("struct", rf"{_VIS}(?:struct|union)\s+(?P<name>{_ID})"),
            _p("enum", rf"{_VIS}enum\s+(?P<name>{_ID})"),
            _p("trait", rf"{_VIS}(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<name>{_ID})"),
            _p("impl", r"(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>(?=\s+\S))?\s*(?P<head>[^{;]*)(?=\{)"),
            _p("module", rf"{_VIS}mod\s+(?P<name>{_ID})\s*(?=\{{)"),
            _p("const", rf"{_VIS}(?:const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:"),
            _p("type", rf"{_VIS}type\s+(?P<name>{_ID})"),
            _p("macro", rf"macro_rules!\s*(?P<name>{_ID})"),
        ],
        r,
    ),
    "javascript": (_JS, _JS_MEMBER),
    "typescript": (_JS, _JS_MEMBER),
    "tsx": (_JS, _JS_MEMBER),
    "go": (
        [
            _p("method", rf"func\s*\(\s*(?:{_ID}\s+)?\*?\s*(?P<scope>{_ID})[^)]*\)\s*(?P<name>{_ID})"),
            _p("function", rf"func\s+(?P<name>{_ID})"),
            _p("struct", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b"),
            _p("interface", rf"type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"),
            _p("type", rf"type\s+(?P<name>{_ID})"),
        ],
        [_p("method", rf"(?P<name>{_ID})\s*\(")],
    ),
    "java": (_JAVA, _JAVA + _JAVA_MEMBER),
    "csharp": (
        c := [_p("module", r"namespace\s+(?P<name>[\w.]+)"), _p("struct", rf"{_MODS}(?:record\s+)?struct\s+(?P<name>{_ID})"), _p("type", rf"{_MODS}delegate\s+[\w<>\[\],.?\s]+?\s(?P<name>{_ID})\s*\("), *_JAVA],
        c + _JAVA_MEMBER + [_p("property", rf"{_NOT_CALL}{_TYPED}(?P<name>{_ID})\s*(?=\{{|=>)")],
    ),
    "c": (_C, []),
    "cpp": (_C, _C + [_p("method", rf"{_MODS}(?P<name>{_NOT_CALL}~?{_ID})\s*\([^;{{}}]*\)[^;{{}}]*(?=\{{|;)")]),
    "objc": (
        _C + [_p("class", rf"@(?:interface|implementation)\s+(?P<name>{_ID})"), _p("interface", rf"@protocol\s+(?P<name>{_ID})[^;]*?$")],
        [_p("method", r"[-+]\s*\([^)]*\)\s*(?P<name>\w+)")],
    ),
    "php": (
        p := [
            _p("module", r"namespace\s+(?P<name>[\w\\]+)"),
            _p("class", rf"{_MODS}class\s+(?P<name>{_ID})"),
            _p("trait", rf"trait\s+(?P<name>{_ID})"),
            _p("interface", rf"interface\s+(?P<name>{_ID})"),
            _p("enum", rf"enum\s+(?P<name>{_ID})"),
            _p("function", rf"{_MODS}function\s+&?\s*(?P<name>{_ID})"),
        ],
        p,
    ),
    "swift": (
        s := [
            _p("class", rf"{_MODS}(?:class|actor|extension)\s+(?!func\b|var\b)(?P<name>[\w.]+)"),
            _p("struct", rf"{_MODS}struct\s+(?P<name>{_ID})"),
            _p("enum", rf"{_MODS}enum\s+(?P<name>{_ID})"),
            _p("interface", rf"{_MODS}protocol\s+(?P<name>{_ID})"),
            _p("function", rf"{_MODS}(?:class\s+)?func\s+(?P<name>{_ID}|[^\s\w(]+)"),
            _p("constructor", rf"{_MODS}(?P<name>init|deinit|subscript)\b[?!]?\s*(?=[<({{])"),
            _p("type", rf"{_MODS}(?:typealias|associatedtype)\s+(?P<name>{_ID})"),
            _p("property", rf"{_MODS}var\s+(?P<name>{_ID})\s*:[^=\n{{]+(?=\{{)"),
        ],
        s,
    ),
    "kotlin": (
        k := [
            _p("interface", rf"{_MODS}(?:fun\s+)?interface\s+(?P<name>{_ID})"),
            _p("enum", rf"{_MODS}enum\s+class\s+(?P<name>{_ID})"),
            _p("class", rf"{_MODS}(?:class|object)\s+(?P<name>{_ID})"),
            _p("object", rf"{_MODS}(?P<name>companion)\s+object\b"),
            _p("function", rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?,. ]+\.)?(?P<name>{_ID})\s*\("),
            _p("constructor", rf"{_MODS}(?P<name>constructor)\s*\("),
            _p("type", rf"{_MODS}typealias\s+(?P<name>{_ID})"),
        ],
        k,
    ),
    "scala": (
        sc := [
            _p("trait", rf"{_MODS}trait\s+(?P<name>{_ID})"),
            _p("class", rf"{_MODS}(?:case\s+)?(?:class|object|enum)\s+(?P<name>{_ID})"),
            _p("function", rf"{_MODS}def\s+(?P<name>{_ID}|[^\s\w(]+)"),
            _p("type", rf"{_MODS}type\s+(?P<name>{_ID})"),
        ],
        sc,
    ),
    "bash": ([_p("function", r"(?:function\s+(?P<name>[\w:.-]+)\s*(?:\(\s*\))?|(?P<name2>[\w:.-]+)\s*\(\s*\))\s*(?=\{)")], []),
}


class _Text:
    """A text with its mask and line starts."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.mask = text, lang, mask(text, lang)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.lines = lines_of(text)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def close(self, at: int, end: int) -> int:
        """Where the bracket at ``at`` closes (the end of the region if it doesn't)."""
        pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
        opener, closer = self.mask[at], pairs[self.mask[at]]
        for m in re.compile(f"[{re.escape(opener)}{re.escape(closer)}]").finditer(self.mask, at, end):
            depth += 1 if m.group() == opener else -1
            if not depth:
                return m.start()
        return end - 1

    def documented(self, line: int, column: int) -> int:
        """The first line of the comments and attributes that stand directly above a definition."""
        first = line
        while first > 1:
            above = self.lines[first - 2]
            body = above.lstrip()
            indent = len(above) - len(body)
            if not body or indent > column + body.startswith("*") or not re.match(r"//|/\*|\*|#(?!\s*(?:include|import|define|if|endif|else|pragma))|--|@(?!(?:interface|implementation|protocol|end|property|synthesize|class|optional|required)\b)\w|\[", body):
                break
            if body.startswith("[") and not re.search(r"\]\s*$", body):
                break
            first -= 1
        return first


def _label(text: str) -> str:
    label = squash(re.sub(r"/\*.*?\*/|(?<![:\"'])//[^\n]*", " ", text, flags=re.S))
    label = re.sub(r"([(\[]) ", r"\1", re.sub(r" ([)\],;])", r"\1", label))
    return clip(re.sub(r"\s*(?:\{|:|=|\bdo)\s*$", "", label).strip(), LABEL_LIMIT)


def braces(text: str, lang: str) -> list[Symbol]:
    """Symbols of a language with bracketed bodies."""
    t, out = _Text(text, lang), []
    top, member = PATTERNS[lang]
    # places still to read: (from, to, parent, whether in a type's body)
    work = [(0, len(text), None, False)]
    while work:
        at, end, parent, inside = work.pop()
        later = []
        while at < end:
            at = _SPACE.match(t.mask, at, end).end()
            if at >= end:
                break
            found = None
            for kind, pattern in (_ENTRY if lang in ("javascript", "typescript", "tsx") else []) + member + top if inside and member is not top else top:
                if (m := pattern.match(t.mask, at, end)) is not None:
                    found = kind
                    break
            if found is None:
                literal = _OBJECT.match(t.mask, at, end) if lang in ("javascript", "typescript", "tsx") else None
                if literal:  # functions of an object literal
                    later.append((literal.end() + 1, t.close(literal.end(), end), parent, True))
                at = _next(t, at, end)
                continue
            if lang == "objc" and found in ("class", "interface") and m.group().startswith("@"):
                eol = t.mask.find("\n", m.end())
                stop = eol if 0 <= eol < end else end
            elif found == "macro" and lang in ("c", "cpp", "objc"):
                stop = m.end()
            else:
                stop = _body(t, m.end(), end, lang, found)
            body = t.mask[stop] if stop < end else ""
            last = t.close(stop, end) if body == "{" else min(stop, end - 1)
            symbol = _symbol(t, m, found, at, stop, last, body, parent, out)
            if symbol is not None:
                out.append(symbol)
                if body == "{" and (found in HOLDERS or found == "test"):
                    later.append((stop + 1, last, len(out) - 1, found != "module" and found != "test"))
                elif lang == "objc" and found in ("class", "interface"):
                    fin = t.mask.find("@end", m.end())
                    symbol.end, last = t.line(fin if fin >= 0 else end - 1), (fin + 3 if fin >= 0 else end - 1)
                    later.append((m.end(), last - 3, len(out) - 1, True))
            at = last + 1
        work.extend(reversed(later))
    return _ordered(out)


_SPACE = re.compile(r"(?:\s|(?:public|private|protected|signals|slots)\s*:(?!:))*")
_OBJECT = re.compile(r"(?:export\s+)?(?:default\s+|(?:const|let|var)\s+[\w$]+[^=;{(]*=\s*|[\w$.]+\s*=\s*)(?=\{)")
_ENTRY = [_p("method", rf"(?P<name>{_ID})\s*:\s*(?:async\s+)?(?:function\b|\([^;{{}}]*\)\s*=>|{_ID}\s*=>)")]


def _next(t: _Text, at: int, end: int) -> int:
    """The beginning of the next statement: after this one's end of line, semicolon or bracketed body."""
    m = re.compile(r"[{(\[;\n}]").search(t.mask, at, end)
    while m:
        c = m.group()
        if c in ";\n}":
            return m.end()
        shut = t.close(m.start(), end)
        if c == "{":
            return shut + 1
        m = re.compile(r"[{(\[;\n}]").search(t.mask, shut + 1, end)
    return end


def _body(t: _Text, at: int, end: int, lang: str, kind: str) -> int:
    """Where a definition's header stops: at its body's bracket, its semicolon, or its last character."""
    if kind == "test":
        at = t.mask.rfind("(", 0, at)
        shut = t.close(at, end)
        brace = t.mask.find("{", at, shut)
        return brace if brace >= 0 else shut
    back = t.mask.rfind("(", 0, at)
    if back >= 0 and t.mask[back:at].strip() == "(":
        at = t.close(back, end) + 1
    quiet = lang in ("go", "swift", "kotlin", "scala", "javascript", "typescript", "tsx")
    for m in re.compile(r"[{(\[;\n=]").finditer(t.mask, at, end):
        if m.start() < at:
            continue
        c = m.group()
        if c == "{" and lang in ("typescript", "tsx") and re.search(r"(?:[<:|&,]|\bis)\s*$", t.mask[max(0, m.start() - 8) : m.start()]):
            at = t.close(m.start(), end) + 1  # an object type
            continue
        if c == "{" or c == ";":
            return m.start()
        if c in "([":
            at = t.close(m.start(), end) + 1
        elif c == "\n" and quiet:
            rest = re.compile(r"\s*").match(t.mask, m.start(), end).end()
            ahead = t.mask[rest : rest + 1]
            if ahead != "{" and not re.match(r"\s*(?:[,.=:&|]|->|where\b|extends\b|implements\b|throws\b)", t.mask[rest : rest + 12]) and not re.search(r"[,(=:&|>]\s*$", t.mask[max(0, m.start() - 8) : m.start()]):
                return m.start()
        elif c == "=" and kind == "type" and lang in ("typescript", "tsx"):
            semi = re.compile(r"[;{(\[]").search(t.mask, m.end(), end)
            while semi and semi.group() != ";":
                semi = re.compile(r"[;{(\[]").search(t.mask, t.close(semi.start(), end) + 1, end)
            if semi:
                return semi.start()
    return end


def _symbol(t: _Text, m: re.Match, kind: str, at: int, stop: int, last: int, body: str, parent: int | None, out: list[Symbol]) -> Symbol | None:
    groups = m.groupdict()
    name, scope = groups.get("name") or groups.get("name2"), groups.get("scope")
    if kind == "impl":
        head = re.sub(r"\bwhere\b.*", "", groups["head"], flags=re.S)
        target = re.split(r"\bfor\b", head)[-1]
        name = re.sub(r"<.*", "", squash(target)).strip("&* ").split("::")[-1]
    if kind == "test":
        quoted = re.compile(r"""\(\s*(["'`])(.*?)\1""", re.S).search(t.text, m.end() - 1, min(m.end() + 300, len(t.text)))
        if not quoted or not re.match(r"\(\s*$", t.text[m.end() - 1 : quoted.start(1)]):
            return None
        name = squash(quoted.group(2))
    if kind == "struct" and name is None and body == "{":
        after = re.compile(r"\s*(\w+)").match(t.mask, last + 1)
        name, last = (after.group(1), after.end() - 1) if after else (None, last)
    if not name:
        return None
    if t.lang in ("c", "cpp", "objc") and "::" in name:
        scope, _, name = re.sub(r"<[^<>]*>", "", name).rpartition("::")
    holder = out[parent].kind if parent is not None else None
    if kind == "function" and holder in ("class", "struct", "interface", "trait", "enum", "impl", "object"):
        kind = "method"
    if kind == "function" and scope:
        kind = "method"
    if kind == "constructor" and t.lang in ("java", "csharp") and (holder is None or name != out[parent].name):
        return None
    if kind == "method" and t.lang in ("java", "csharp") and holder and name == out[parent].name:
        kind = "constructor"
    if t.lang == "kotlin" and name == "companion":
        kind, name = "class", "companion object"
    if t.lang == "swift" and kind == "class" and re.match(r"(?:[\w@]+\s+)*extension\b", m.group()):
        kind = "impl"
    if t.lang == "objc" and kind == "method":
        kinds = re.findall(r"(\w+)\s*:", re.sub(r"\([^()]*\)", "", t.mask[m.start("name") : stop]))
        name = "".join(k + ":" for k in kinds) or name
    if kind == "method" and t.lang == "php" and name == "__construct":
        kind = "constructor"
    if kind in ("function", "method") and t.lang in ("c", "cpp") and body not in ("{", ";"):
        return None
    line, first = t.line(at), t.line(m.start())
    column = at - t.starts[line - 1]
    plain = holder == "interface" and t.lang in ("typescript", "tsx")
    label = _label(t.text[at : last + 1] if kind == "macro" else t.text[at : stop + (body == ";" and not plain)])
    if t.lang == "go" and kind in ("struct", "interface"):
        label = re.sub(r"\s+(?:struct|interface)$", "", label)
    collapse = None
    if body == "{" and (kind in CALLABLE and kind != "macro" or kind == "property"):
        a, b = t.line(stop) + 1, t.line(last) - 1
        collapse = (a, b) if b - a >= 2 else None
    depth = out[parent].depth + 1 if parent is not None else 0
    return Symbol(name, kind, t.documented(first, column), line, t.line(last), label, scope, collapse, parent, depth)


def _ordered(symbols: list[Symbol]) -> list[Symbol]:
    """By place in the text, parents before what they hold; indices of parents follow."""
    order = sorted(range(len(symbols)), key=lambda i: (symbols[i].line, symbols[i].depth, i))
    at = {i: k for k, i in enumerate(order)}
    for s in symbols:
        s.parent = at[s.parent] if s.parent is not None else None
    holders = {s.parent for s in symbols}
    for k, i in enumerate(order):
        if symbols[i].kind == "test" and k in holders:
            symbols[i].collapse = None
    return [symbols[i] for i in order]


def python(text: str) -> list[Symbol]:
    """Functions and classes from Python's own parser; by indentation where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return indented(text)
    t, out = _Text(text, "python"), []
    work = [(n, None) for n in reversed(tree.body)]
    while work:
        node, parent = work.pop()
        if isinstance(node, (ast.If, ast.Try, ast.With)) and parent is None:
            work.extend((n, parent) for n in reversed(node.body))
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        is_class = isinstance(node, ast.ClassDef)
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        kind = "class" if is_class else "method" if parent is not None else "function"
        body = node.body[0]
        head = "\n".join(t.lines[node.lineno - 1 : max(node.lineno, body.lineno - (body.lineno > node.lineno))])
        if body.lineno == node.lineno:
            head = head[: body.col_offset]
        collapse = None
        if not is_class and body.lineno > node.lineno:
            doc = isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str)
            a = body.lineno + 1 if doc else body.lineno
            collapse = (a, node.end_lineno) if node.end_lineno - a >= 2 else None
        out.append(Symbol(node.name, kind, t.documented(first, node.col_offset), node.lineno, node.end_lineno, _label(re.sub(r"#[^\n]*", "", head)), None, collapse, parent, out[parent].depth + 1 if parent is not None else 0))
        if is_class:
            me = len(out) - 1
            work.extend((n, me) for n in reversed(node.body))
    return out


def indented(text: str) -> list[Symbol]:
    """Definitions of a Python-like text by indentation."""
    t, out, open_ = _Text(text, "python"), [], []
    masked = lines_of(t.mask)
    for i, line in enumerate(masked, 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        m = re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line)
        if m and not any(out[k].kind != "class" for _, k in open_):
            parent = open_[-1][1] if open_ else None
            kind = "class" if m.group(1) == "class" else "method" if parent is not None else "function"
            out.append(Symbol(m.group(2), kind, t.documented(i, indent), i, i, _label(t.lines[i - 1].split("#")[0]), None, None, parent, len(open_)))
            open_.append((indent, len(out) - 1))
        for _, k in open_:
            out[k].end = i
    for s in out:
        if s.kind != "class" and s.end - s.line >= 3:
            s.collapse = (s.line + 1, s.end)
    return out


_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_LUA_OPEN = re.compile(r"\bfunction\b|\bthen\b|\bdo\b|\brepeat\b")
_LUA_SHUT = re.compile(r"\bend\b|\buntil\b|\belseif\b")


def ended(text: str, lang: str) -> list[Symbol]:
    """Symbols of Ruby and Lua, whose bodies are closed by ``end``."""
    t, out = _Text(text, lang), []
    masked = lines_of(t.mask)
    open_: list[tuple[int | None, str]] = []  # (symbol or None, kind)
    tables: list[tuple[int, str]] = []  # (depth of brackets, name) of tables that are being read
    depth = 0
    for i, line in enumerate(masked, 1):
        ruby = lang == "ruby"
        if ruby:
            m = re.match(r"\s*(class|module|def)\s+(?P<name>(?:self\.)?[\w:]+[?!=]?)", line)
            kind = {"class": "class", "module": "module", "def": "function"}[m.group(1)] if m else None
            name = m.group("name").removeprefix("self.") if m else None
            spec = None if m else re.match(r"""\s*(?:RSpec\.)?(describe|context|it)\b\s*\(?\s*(?:(["'])(.*?)\2|([A-Z][\w:]*))""", t.lines[i - 1])
            if spec and re.search(r"\bdo\b", line):
                kind, name = "test", spec.group(3) or spec.group(4)
        else:
            m = re.match(r"\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)|\s*(?:local\s+)?(?P<name2>[\w.]+)\s*=\s*function\b", line)
            typ = re.match(r"\s*(?:export\s+)?type\s+(\w+)", line) if lang == "luau" else None
            kind, name = ("function", m.group("name") or m.group("name2")) if m else ("type", typ.group(1)) if typ else (None, None)
        inside = any(k in ("function", "method") for _, k in open_)
        symbol = None
        if name and not inside:
            parent = next((s for s, _ in reversed(open_) if s is not None), None)
            scope = None
            if not ruby and kind == "function":
                kind = "method" if ":" in name else kind
                scope, _, name = re.sub(":", ".", name).rpartition(".")
                if not scope and m.group("name2") and tables and not re.match(r"\s*local\b", line):
                    scope = tables[-1][1]
            elif ruby and re.fullmatch(r"[\w:]+", name) and "::" in name:
                scope, _, name = name.rpartition("::")
            if ruby and kind == "function" and parent is not None and out[parent].kind in ("class", "module"):
                kind = "method"
            column = len(line) - len(line.lstrip())
            out.append(Symbol(name, kind, t.documented(i, column), i, i, _label(t.lines[i - 1]), scope or None, None, parent, out[parent].depth + 1 if parent is not None else 0))
            symbol = len(out) - 1
        table = re.match(r"\s*(?:local\s+)?([\w.]+)\s*(?::[^=]*)?=\s*\{", line) if not ruby else None
        if table:
            tables.append((depth, table.group(1)))
        depth += line.count("{") - line.count("}")
        while tables and depth <= tables[-1][0]:
            tables.pop()
        if kind == "type":
            brace = t.mask.find("{", t.starts[i - 1], t.starts[i] if i < len(t.starts) else None)
            out[-1].end = t.line(t.close(brace, len(t.mask))) if brace >= 0 else i
            continue
        opens = (1 if _RUBY_OPEN.search(line) else 0) if ruby else len(_LUA_OPEN.findall(line))
        shuts = len(re.findall(r"\bend\b", line)) if ruby else len(_LUA_SHUT.findall(line))
        if ruby and re.search(r"\bdef\b[^=\n]*\)?\s*=\s", line):
            opens = 0
        for k in range(opens):
            open_.append((symbol if k == 0 else None, kind if k == 0 and symbol is not None else "block"))
        for _ in range(min(shuts, len(open_))):
            s, _k = open_.pop()
            if s is not None:
                out[s].end = i
    for s, _ in open_:
        if s is not None:
            out[s].end = len(t.lines)
    for s in out:
        if s.kind in CALLABLE and s.end - 1 - s.line >= 3:
            s.collapse = (s.line + 1, s.end - 1)
    return out


def outline(text: str, lang: str) -> list[Symbol]:
    """Symbols of a code text, none for a language without an extractor."""
    if lang == "python":
        return python(text)
    if lang in ("ruby", "lua", "luau"):
        return ended(text, lang)
    return braces(text, lang) if lang in PATTERNS else []
