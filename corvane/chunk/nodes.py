"""Source text to syntax nodes: exact for Python (ast), by scanning for the other languages.

A scanner blanks out comments and strings, cuts a region into items at depth zero of its brackets, and names each item's node type
from its first words. That is an approximation of a grammar: it finds definitions, not expressions. Another parser can take its place:
what the chunker needs is `parse(content, language) -> list[Node]`.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field


@dataclass
class Node:
    type: str
    start: int  # offset of the first character
    end: int  # offset after the last
    name: str = ""
    inner: "Node | None" = None  # what an export, a decorated definition or a template holds
    children: list["Node"] = field(default_factory=list)  # members, where the node's body is one that is looked into


# --- Python


def _python(content: str) -> list[Node]:
    tree = ast.parse(content)
    starts = [0]
    for line in content.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines = content.split("\n")

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    def node(n: ast.stmt) -> Node:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(n, ast.ClassDef) else "function_definition"
            own = Node(kind, offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset), n.name)
            if isinstance(n, ast.ClassDef):
                own.children = [node(m) for m in n.body]
            if n.decorator_list:
                first = n.decorator_list[0]
                at = content.rfind("@", 0, offset(first.lineno, first.col_offset) + 1)
                return Node("decorated_definition", at, own.end, own.name, own)
            return own
        return Node("statement", offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset))

    return [node(n) for n in tree.body]


# --- blanking of comments and strings

_STRING = {
    "default": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "rust": r'b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\(?:u\{[^}]*\}|x..|.)|[^\'\\\n])\'',
    "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.[^\']*|[^\'\\\n])\'',
    "js": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
    "scala": r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'',
    "c_sharp": r'@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "php": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
    "zig": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|\\\\[^\n]*',
}
_COMMENT = {"default": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "php": r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)", "zig": r"//[^\n]*", "ruby": r"#[^\n]*|^=begin\b.*?^=end[^\n]*"}
_STRING["javascript"] = _STRING["typescript"] = _STRING["tsx"] = _STRING["js"]
_STRING["ruby"] = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`(?:\\.|[^`\\])*`'


def blanked(content: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces, line ends kept."""
    comment, string = _COMMENT.get(language, _COMMENT["default"]), _STRING.get(language, _STRING["default"])
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def swap(m: re.Match) -> str:
        s = m[0]
        return blank(s) if m["comment"] else s[0] + blank(s[1:-1]) + s[-1] if len(s) > 1 else s

    return re.sub(f"(?P<comment>{comment})|(?:{string})".replace(r"\1", r"\2"), swap, content, flags=re.S | re.M)


# --- items of a region

_OPEN, _CLOSE = "({[", ")}]"
_STARTERS = {
    "js": r"(?:export|import|function|async|class|const|let|var|interface|type|enum|abstract|declare|namespace|@)",
    "scala": r"(?:class|object|trait|def|val|var|case|abstract|sealed|final|implicit|private|protected|override|lazy|import|package|type|given|extension|enum|@)",
    "default": None,
}


def items(code: str, lo: int, hi: int, language: str) -> list[tuple[int, int]]:
    """Offsets of the items between lo and hi: up to a semicolon, a closing brace, or a line end where the language ends statements there."""
    family = "js" if language in ("javascript", "typescript", "tsx") else language
    starter = re.compile(_STARTERS[family] + r"\b|@") if _STARTERS.get(family) else None
    by_line = language in ("go", "scala") or family == "js"
    out, depth, start, i = [], 0, None, lo
    while i < hi:
        c = code[i]
        if start is None:
            if c.isspace() or c in ";,":
                i += 1
                continue
            if language == "php" and code.startswith(("<?", "?>"), i):
                i = (code.find("\n", i) + 1) or hi
                continue
            if language == "rust" and c == "#":  # an attribute is a node of its own
                i = _matching(code, code.find("[", i), hi)
                continue
            if language in ("c", "cpp", "c_sharp") and c == "#":
                end = i
                while True:
                    end = code.find("\n", end + 1)
                    if end < 0 or end >= hi or code[end - 1] != "\\":
                        break
                end = hi if end < 0 else min(end, hi)
                out.append((i, end))
                i = end
                continue
            start = i
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
            if c == "}" and depth == 0:
                after = re.compile(r"[ \t]*\n?\s*").match(code, i + 1).end()
                following = code[after] if after < hi else ""
                same_line = "\n" not in code[i + 1 : after]
                goes_on = following in ";=,.)?:" or (same_line and following and (following.isalnum() or following in "([_*&") and _continues(code[start:i], language))
                if family == "js" and following == "(":
                    goes_on = True
                if re.match(r"\s*(?:else|catch|finally)\b", code[i + 1 : hi][:40]):
                    goes_on = True
                if not goes_on:
                    out.append((start, i + 1))
                    start = None
                elif following == ";" and language in ("c", "cpp") and not re.match(r"(?:[\w\s]*\btypedef\b)", code[start:i]) and re.match(r"(?:class|struct|enum|union|namespace)\b", code[start:i]):
                    out.append((start, i + 1))  # a specifier ends before its semicolon
                    start = None
                    i = after
        elif c == ";" and depth == 0:
            out.append((start, i + 1))
            start = None
        elif c == "\n" and depth == 0 and by_line:
            rest = re.compile(r"\s*").match(code, i).end()
            done = code[start:i].rstrip()
            if language == "go":
                ends = not done.endswith((",", "=", "+", "-", "*", "/", "&&", "||", "(", "{", "."))
            else:
                ends = bool(starter and starter.match(code, rest)) and not re.search(r"(?:^|\s)(?:@[\w.()]+|export|default|async|abstract|private|protected|override|final|implicit|=)$", done)
            if ends:
                out.append((start, i))
                start = None
        i += 1
    if start is not None and code[start:hi].strip():
        out.append((start, start + len(code[start:hi].rstrip())))
    return out


def _continues(head: str, language: str) -> bool:
    """Whether a declaration goes on behind its braces on the same line: `typedef struct { } name;`, `struct { } name;`."""
    return language in ("c", "cpp") and bool(re.match(r"\s*(?:typedef|struct|union|enum|static|const|extern)\b", head)) and "(" not in head.split("{")[0]


def _matching(code: str, at: int, hi: int) -> int:
    """Offset behind the bracket that closes the one at `at`."""
    if at < 0:
        return hi
    depth = 0
    for i in range(at, hi):
        if code[i] in _OPEN:
            depth += 1
        elif code[i] in _CLOSE:
            depth -= 1
            if depth == 0:
                return i + 1
    return hi


# --- node types by first words

_W = r"[A-Za-z_$][\w$]*"
_RUST_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_JAVA_MOD = r"(?:(?:@[\w.]+(?:\s*\([^)]*\))?|public|private|protected|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*"
_CS_MOD = r"(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|unsafe|new|extern|ref|file|required)\s+)*"
_PHP_MOD = r"(?:#\[[^\]]*\]\s*)*(?:(?:public|private|protected|static|final|abstract|readonly)\s+)*"
_SCALA_MOD = r"(?:(?:@\w+(?:\([^)]*\))?|private(?:\[\w+\])?|protected(?:\[\w+\])?|final|sealed|abstract|implicit|lazy|override|case|inline|open)\s+)*"
_GENERIC = r"(?:<[^>{]*>+\s*)?"

#: language -> (pattern at the start of the item, node type, whether its body's members are looked into)
_TOP: dict[str, list[tuple[str, str, bool]]] = {
    "rust": [
        (_RUST_VIS + rf"(?:(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+(?P<n>{_W})[^{{;]*;", "function_signature_item", False),
        (_RUST_VIS + rf"(?:(?:const|async|unsafe|default|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+(?P<n>{_W})", "function_item", False),
        (_RUST_VIS + rf"struct\s+(?P<n>{_W})", "struct_item", False),
        (_RUST_VIS + rf"enum\s+(?P<n>{_W})", "enum_item", False),
        (_RUST_VIS + rf"(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<n>{_W})", "trait_item", True),
        (r"(?:default\s+)?(?:unsafe\s+)?impl\b", "impl_item", True),
        (_RUST_VIS + rf"type\s+(?P<n>{_W})", "type_item", False),
        (_RUST_VIS + rf"const\s+(?P<n>{_W})", "const_item", False),
        (_RUST_VIS + rf"static\s+(?:mut\s+)?(?P<n>{_W})", "static_item", False),
        (rf"macro_rules!\s*(?P<n>{_W})", "macro_definition", False),
        (_RUST_VIS + rf"mod\s+(?P<n>{_W})", "mod_item", True),
    ],
    "go": [
        (rf"func\s*\(\s*(?:{_W}\s+)?(?P<r>[^)]*?)\s*\)\s*(?P<n>{_W})", "method_declaration", False),
        (rf"func\s+(?P<n>{_W})", "function_declaration", False),
        (rf"type\s*\(?\s*(?P<n>{_W})(?!\s*=)", "type_declaration", False),
        (r"type\b", "type_declaration", False),
        (rf"const\s*\(?\s*(?P<n>{_W})", "const_declaration", False),
        (rf"var\s*\(?\s*(?P<n>{_W})", "var_declaration", False),
    ],
    "java": [
        (_JAVA_MOD + rf"class\s+(?P<n>{_W})", "class_declaration", True),
        (_JAVA_MOD + rf"interface\s+(?P<n>{_W})", "interface_declaration", False),
        (_JAVA_MOD + rf"enum\s+(?P<n>{_W})", "enum_declaration", False),
        (_JAVA_MOD + rf"record\s+(?P<n>{_W})\s*{_GENERIC}\(", "record_declaration", False),
    ],
    "c_sharp": [
        (_CS_MOD + r"namespace\s+(?P<n>[\w.]+)\s*\{", "namespace_declaration", True),
        (_CS_MOD + rf"class\s+(?P<n>{_W})", "class_declaration", True),
        (_CS_MOD + rf"interface\s+(?P<n>{_W})", "interface_declaration", True),
        (_CS_MOD + rf"record\s+(?:class\s+)?(?P<n>{_W})", "record_declaration", True),
        (_CS_MOD + rf"struct\s+(?P<n>{_W})", "struct_declaration", True),
        (_CS_MOD + rf"enum\s+(?P<n>{_W})", "enum_declaration", False),
    ],
    "php": [
        (_PHP_MOD + rf"class\s+(?P<n>{_W})", "class_declaration", True),
        (rf"interface\s+(?P<n>{_W})", "interface_declaration", True),
        (rf"trait\s+(?P<n>{_W})", "trait_declaration", True),
        (rf"enum\s+(?P<n>{_W})", "enum_declaration", False),
        (rf"function\s+&?\s*(?P<n>{_W})", "function_definition", False),
    ],
    "scala": [
        (_SCALA_MOD + rf"class\s+(?P<n>{_W})", "class_definition", False),
        (_SCALA_MOD + rf"object\s+(?P<n>{_W})", "object_definition", False),
        (_SCALA_MOD + rf"trait\s+(?P<n>{_W})", "trait_definition", False),
        (_SCALA_MOD + rf"def\s+(?P<n>{_W})", "function_definition", False),
        (_SCALA_MOD + r"val\s+(?P<n>[^=:]+?)\s*[=:]", "val_definition", False),
    ],
    "zig": [
        (rf"(?:pub\s+)?(?:export\s+|extern\s+(?:\"[^\"]*\"\s+)?|inline\s+|noinline\s+)?fn\s+(?P<n>{_W})", "function_declaration", False),
        (rf"(?:pub\s+)?(?:export\s+|extern\s+|threadlocal\s+)*(?:const|var)\s+(?P<n>{_W})", "variable_declaration", False),
        (r"test\b", "test_declaration", False),
    ],
    "javascript": [
        (rf"(?:async\s+)?function\s*\*\s*(?P<n>{_W})", "generator_function_declaration", False),
        (rf"(?:async\s+)?function\s+(?P<n>{_W})", "function_declaration", False),
        (rf"class\s+(?P<n>{_W})", "class_declaration", True),
        (rf"(?:const|let)\s+(?!enum\b)(?P<n>{_W}|[{{\[][^=]*[}}\]])", "lexical_declaration", False),
        (r"var\s", "variable_declaration", False),
    ],
}
_TOP["typescript"] = _TOP["tsx"] = [
    (rf"abstract\s+class\s+(?P<n>{_W})", "abstract_class_declaration", True),
    (rf"interface\s+(?P<n>{_W})", "interface_declaration", False),
    (rf"type\s+(?P<n>{_W})\s*{_GENERIC}=", "type_alias_declaration", False),
    (rf"(?:const\s+)?enum\s+(?P<n>{_W})", "enum_declaration", False),
    *_TOP["javascript"],
]
_COMPILED = {k: [(re.compile(p, re.S), t, m) for p, t, m in v] for k, v in _TOP.items()}

_QUALIFIER = r"(?:(?:static|extern|const|inline|volatile|register|constexpr|virtual|explicit|thread_local|_Noreturn|mutable)\s+)*"
_C_TYPE = re.compile(_QUALIFIER + r"((?:(?:unsigned|signed|long|short)\s+)+(?:int|char|long|double)?|(?:struct|union|enum)\s+\w+|[\w:]+(?:<[^;{}()]*>)?)")


def _c_item(content: str, code: str, lo: int, hi: int, language: str) -> Node | None:
    text = code[lo:hi]
    m = re.match(r"#\s*define\s+(\w+)(\(?)", content[lo:hi])
    if m:
        return Node("preproc_function_def" if m[2] else "preproc_def", lo, hi, m[1])
    if text.startswith("#"):
        return Node("preproc", lo, hi)
    if language == "cpp":
        m = re.match(r"template\s*<", text)
        if m:
            at, depth = m.end(), 1
            while at < len(text) and depth:
                depth += (text[at] == "<") - (text[at] == ">")
                at += 1
            at += len(text[at:]) - len(text[at:].lstrip())
            inner = _c_item(content, code, lo + at, hi, language)
            return Node("template_declaration", lo, hi, inner.name if inner else "", inner)
        m = re.match(r"(?:inline\s+)?namespace\s*([\w:]*)\s*\{", text)
        if m:
            return _with_members(Node("namespace_definition", lo, hi, m[1]), content, code, language, False)
    if re.match(r"typedef\b", text):
        m = re.search(r"\(\s*\*\s*(\w+)\s*\)\s*\(", text) or re.search(r"(\w+)\s*(?:\[[^\]]*\]\s*)*;?\s*$", text)
        return Node("type_definition", lo, hi, m[1] if m and "(*" not in text.replace(" ", "") else "")
    m = re.match(r"(class|struct|union|enum)(?:\s+class)?\s+(?:alignas\([^)]*\)\s*|\[\[[^\]]*\]\]\s*)?(\w*)[^;{()=]*\{", text)
    if m and text.rstrip().endswith("}"):
        return _with_members(Node({"class": "class_specifier"}.get(m[1], f"{m[1]}_specifier"), lo, hi, m[2]), content, code, language, True) if m[1] != "enum" else Node("enum_specifier", lo, hi, m[2])
    if not re.match(r"[A-Za-z_~]", text) or re.match(r"(?:using|return|public|private|protected|friend|static_assert|import|module)\b", text):
        return Node("other", lo, hi)
    head = text.split("{")[0]
    called = re.search(r"([~\w:]+(?:\s*operator\s*\S+)?)\s*\(", head)
    of = _C_TYPE.match(text)
    if called and text.rstrip().endswith("}") and "=" not in head.split("(")[0]:
        before = head[: called.start()]
        # the name of a function that gives a pointer lies deeper, so its type is what is found
        return Node("function_definition", lo, hi, of[1].strip() if "*" in before or "&" in before else called[1])
    return Node("declaration", lo, hi, of[1].strip() if of else "")


_MEMBER = {
    "java": (_JAVA_MOD + rf"{_GENERIC}(?P<t>[\w.<>\[\],?\s&]+?\s+)?(?P<n>{_W})\s*\(", ("method_declaration", "constructor_declaration")),
    "c_sharp": (_CS_MOD + rf"(?P<t>[\w.<>\[\],?\s()]+?\s+)?(?P<n>{_W})\s*{_GENERIC}\(", ("method_declaration", "constructor_declaration")),
    "php": (_PHP_MOD + rf"function\s+&?\s*(?P<t>)(?P<n>{_W})\s*\(", ("method_declaration", "method_declaration")),
    "js": (rf"(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract|declare|\*)\s+)*\*?(?P<t>)(?P<n>[#\w$]+|\[[^\]]*\])\s*{_GENERIC}\(", ("method_definition", "method_definition")),
}
_MEMBER["javascript"] = _MEMBER["typescript"] = _MEMBER["tsx"] = _MEMBER["js"]
_NOT_A_NAME = {"if", "for", "while", "switch", "return", "new", "catch", "throw", "else", "do", "try", "using", "lock", "foreach"}


def _with_members(node: Node, content: str, code: str, language: str, inside_class: bool) -> Node:
    at = code.find("{", node.start, node.end)
    if at >= 0:
        hi = _matching(code, at, node.end) - 1
        for lo, end in items(code, at + 1, hi, language):
            if language in ("c", "cpp") and (m := re.compile(r"(?:public|private|protected)\s*:\s*").match(code, lo, end)):
                lo = m.end()
            if lo < end and (member := _item(content, code, lo, end, language, inside_class)):
                if inside_class and language == "cpp" and member.type == "declaration":
                    member.type = "field_declaration"
                node.children.append(member)
    return node


def _item(content: str, code: str, lo: int, hi: int, language: str, member: bool = False) -> Node | None:
    if language in ("c", "cpp"):
        return _c_item(content, code, lo, hi, language)
    if language in ("javascript", "typescript", "tsx"):
        found = re.compile(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*export\b\s*(?P<d>default\b\s*)?(?:declare\s+)?").match(code, lo, hi)
        if found and not member:
            inner = _item(content, code, found.end(), hi, language)
            if found["d"] and (inner is None or inner.type == "other"):
                rest = code[found.end() : hi]
                kind = "function_expression" if re.match(r"(?:async\s+)?function\b", rest) else "class" if re.match(r"(?:abstract\s+)?class\b", rest) else "expression"
                inner = Node(kind, found.end(), hi)
            return Node("export_statement", lo, hi, inner.name if inner else "", inner)
    start = lo
    if language in ("javascript", "typescript", "tsx") and (m := re.compile(r"(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:declare\s+)?").match(code, lo, hi)):
        start = m.end()
    if not member or language not in _MEMBER:
        found = None
    else:
        pattern, (with_type, without) = _MEMBER[language]
        found = re.compile(pattern, re.S).match(code, start, hi)
        if found and (found["n"] in _NOT_A_NAME or "=" in code[start : found.end()] or re.search(r"\b(?:class|interface|enum|struct|record)\b", found[0])):
            found = None
    if found:
        return Node(with_type if found["t"] else without, lo, hi, found["n"])
    for pattern, kind, members in _COMPILED[language]:
        m = pattern.match(code, start, hi)
        if not m:
            continue
        if member and language in ("javascript", "typescript", "tsx") and kind not in ("class_declaration",):
            continue
        name = m.groupdict().get("n") or ""
        node = Node(kind, lo, hi, name.strip())
        if kind == "impl_item":
            head = re.sub(r"^(?:default\s+)?(?:unsafe\s+)?impl\s*", "", content[lo : code.find("{", lo, hi)] if "{" in code[lo:hi] else content[lo:hi])
            if head.startswith("<"):
                head = head[_angle(head) :]
            head = re.split(r"\bwhere\b", head)[0]
            of = re.split(r"\bfor\s+(?!<)", head, maxsplit=1)
            node.name = " ".join(of[0].split()) if len(of) == 1 else f"{' '.join(of[0].split())} for {' '.join(of[1].split())}"
        elif kind == "method_declaration" and language == "go":
            node.name = f"{m['r'].strip()}.{name}"
        elif kind == "test_declaration":
            s = re.compile(r'test\s*"((?:\\.|[^"\\])*)"').match(content, lo, hi)
            node.name = s[1] if s else ""
        elif kind in ("lexical_declaration", "val_definition"):
            node.name = content[m.start("n") : m.end("n")].strip()
        return _with_members(node, content, code, language, kind not in ("mod_item", "namespace_declaration")) if members else node
    return Node("other", lo, hi)


def _angle(s: str) -> int:
    depth = 0
    for i, c in enumerate(s):
        depth += (c == "<") - (c == ">" and s[i - 1] != "-")
        if depth == 0:
            return i + 1
    return len(s)


# --- Ruby

_RUBY_OPEN = re.compile(r"^\s*(?:(?:private|public|protected|module_function|private_class_method)\s+)?(class|module|def|if|unless|while|until|case|begin|for)\b")
_RUBY_DO = re.compile(r"\bdo\b(?:\s*\|[^|]*\|)?\s*$")
_RUBY_BLOCK = re.compile(r"=\s*(?:if|unless|case|begin|while)\b")


def _ruby(content: str) -> list[Node]:
    code = blanked(content, "ruby")
    root: list[Node] = []
    stack: list[Node] = []
    at = 0
    for line in code.split("\n"):
        start = at + len(line) - len(line.lstrip())
        end = at + len(line.rstrip())
        home = stack[-1].children if stack else root
        opened = _RUBY_OPEN.match(line)
        if opened and not re.search(r"\bend\s*$", line) and not (opened[1] == "def" and re.search(r"\bdef\s+[\w.?!]+(?:\([^)]*\))?\s*=\s", line)):
            word = opened[1]
            node = Node({"class": "class", "module": "module"}.get(word, word), start, end)
            if word in ("class", "module"):
                m = re.search(r"(?:class|module)\s+([\w:]+)", line)
                node.name = m[1] if m else ""
            elif word == "def":
                m = re.search(r"def\s+(?:([\w]+)\.)?([^\s(;]+)", line)
                node.type, node.name = ("singleton_method", f"{m[1]}.{m[2]}") if m and m[1] else ("method", m[2] if m else "")
            home.append(node)
            stack.append(node)
        elif opened and opened[1] == "def":
            m = re.search(r"def\s+(?:([\w]+)\.)?([^\s(;=]+)", line)
            home.append(Node("singleton_method" if m and m[1] else "method", start, end, f"{m[1]}.{m[2]}" if m and m[1] else m[2] if m else ""))
        elif _RUBY_DO.search(line) or _RUBY_BLOCK.search(line):
            m = re.match(r"\s*([A-Za-z_@$][\w:.@]*)\s*=(?![=~>])", line)
            node = Node("assignment" if m else "call", start, end, m[1] if m else "")
            home.append(node)
            stack.append(node)
        elif re.match(r"\s*end\b", line):
            if stack:
                stack.pop().end = at + line.index("end") + 3
        elif m := re.match(r"\s*([A-Za-z_@$][\w:.@]*(?:\[[^\]]*\])?)\s*=(?![=~>])", line):
            home.append(Node("assignment", start, end, content[at + m.start(1) : at + m.end(1)]))
        at += len(line) + 1
    for node in stack:
        node.end = len(content)
    return root


def parse(content: str, language: str) -> list[Node]:
    """Top-level nodes in order. Python that doesn't parse raises SyntaxError; the scanners take any text."""
    if language == "python":
        return _python(content)
    if language == "ruby":
        return _ruby(content)
    code = blanked(content, language)
    found = (_item(content, code, lo, hi, language) for lo, hi in items(code, 0, len(code), language))
    return [n for n in found if n]
