"""Syntax checks for Python, JavaScript, TypeScript, Java, Go and C: ``valid(language, text)``.

Python is checked by the interpreter's own compiler. The brace languages share one lexer, driven by a table, and one
recursive-descent core with a small statement grammar per language. Only syntax counts; names and types don't.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections import Counter
from functools import lru_cache

# The language that each extension stands for.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "java": "java", "go": "go", "c": "c", "h": "c",
}
LANGUAGES = ("python", "javascript", "typescript", "java", "go", "c")

_JS_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
# Reserved words.
RESERVED = {
    "javascript": frozenset(_JS_WORDS.split()),
    "typescript": frozenset(_JS_WORDS.split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "c": frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignof _Alignas _Atomic _Generic _Noreturn _Static_assert _Thread_local".split()),
}
# Operators of each language, and those that join two operands.
_COMMON = "== != <= >= && || << >> += -= *= /= %= &= |= ^= <<= >>= ++ -- + - * / % & | ^ ! < > = . , ; : ( ) [ ] { }"
OPERATORS = {
    "javascript": _COMMON + " === !== ** ** **= => ?. ?? ??= &&= ||= >>> >>>= ... ? ~ @ #",
    "java": _COMMON + " >>> >>>= -> :: ... ? ~ @",
    "go": _COMMON + " := <- &^ &^= ... ~",
    "c": _COMMON + " -> ... ? ~",
}
OPERATORS["typescript"] = OPERATORS["javascript"]
_BINARY = set("== != <= >= && || << >> + - * / % & | ^ < >".split())
BINARY = {
    "javascript": _BINARY | set("=== !== ** ?? >>> in instanceof".split()), "java": _BINARY | {">>>"},
    "go": _BINARY | {"&^"}, "c": _BINARY,
}
BINARY["typescript"] = BINARY["javascript"]
_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= ??= &&= ||= &^= :=".split())
_DIRECTIVES = frozenset("include define undef if ifdef ifndef else elif endif error warning pragma line".split())
_STRINGS = {
    "javascript": r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|[\s\S]))*\'',
    "java": r'"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)\'',
    "go": r'`[^`]*`|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\[xuU0-7][0-9a-fA-F]*|\\.)\'',
    "c": r'(?:u8|[LuU])?"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|[LuU]?\'(?:[^\'\\\n\r]|\\.)+\'',
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_NUMBER = r"0[xX][0-9a-fA-F_]+[nuUlL]*|0[bBoO][0-7_]+[nlLuU]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[nfFdDlLuUi]*"
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")


FRAMES_A_TOKEN, MOST_FRAMES = 24, 20_000_000  # room for nesting: frames live on the heap, so it grows with the text


class Bad(Exception):
    """The text isn't valid in the language."""


@lru_cache(None)
def _lexer(lang: str) -> re.Pattern:
    ops = sorted(set(OPERATORS[lang].split()), key=lambda o: (-len(o), o))
    parts = [
        ("blank", r"[ \t\f\v\xa0\ufeff]+" if lang in ("javascript", "typescript") else r"[ \t\f\v]+"),
        ("line", r"\r\n|[\n\r\u2028\u2029]" if lang in ("javascript", "typescript") else r"\r\n|[\n\r]"),
        ("note", r"//[^\n\r]*|/\*[\s\S]*?\*/"),
        ("str", _STRINGS[lang]),
        ("num", rf"(?:{_NUMBER})(?![A-Za-z0-9_$])"),
        ("id", r"[^\W\d][\w]*" if lang in ("go", "c") else r"(?:[^\W\d]|[$_])[\w$]*"),
    ]
    if lang == "c":
        parts.insert(2, ("directive", r"(?m:^)[ \t]*#(?:[^\n\r\\]|\\(?:\r\n|[\s\S]))*"))
    parts.append(("op", "|".join(map(re.escape, ops))))
    return re.compile("|".join(f"(?P<{n}>{p})" for n, p in parts))


def _lex(lang: str, text: str, notes: list[tuple[int, str, bool]] | None = None, places: list[int] | None = None) -> tuple[list[str], list[str], list[bool]]:
    """Kinds, texts and whether a new line stands before, of all tokens; ends with an ``eof``. ``notes`` takes the comments
    (place, text, whether first on their line), ``places`` where each token starts."""
    match, kinds, words, fresh = _lexer(lang).match, [], [], []
    script = lang in ("javascript", "typescript")
    at, end, line, templates, depth, start = 0, len(text), True, [], 0, 0

    def add(kind: str, word: str) -> None:
        nonlocal line
        kinds.append(kind), words.append(word), fresh.append(line)
        if places is not None:
            places.append(start)
        line = False

    def template(at: int) -> int:
        """From inside a template to its end or its next substitution."""
        while at < end:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                add("op", "`end")
                return at + 1
            elif c == "$" and text.startswith("${", at):
                templates.append(depth)
                add("op", "${")
                return at + 2
            else:
                at += 1
        raise Bad

    while at < end:
        c, start = text[at], at
        if script and c == "`":
            add("op", "`")
            at = template(at + 1)
            continue
        if script and c == "}" and templates and templates[-1] == depth:
            templates.pop()
            add("op", "}$")
            at = template(at + 1)
            continue
        if script and c == "/" and not text.startswith(("//", "/*"), at):
            before = (kinds[-1], words[-1]) if kinds else ("op", "(")
            operand = before[0] in ("num", "str", "re") or before[1] in (")", "]", "}", "`end", "this", "super", "null", "true", "false") or (before[0] == "id" and before[1] not in RESERVED[lang])
            if not operand and (m := _REGEX.match(text, at)):
                add("re", m.group())
                at = m.end()
                continue
        m = match(text, at)
        if not m or m.end() == at:
            raise Bad
        kind, word = m.lastgroup, m.group()
        at = m.end()
        if kind == "blank":
            continue
        if kind in ("line", "note"):
            broken = kind == "line" or "\n" in word or "\r" in word
            if broken and lang == "go" and kinds and not line and (kinds[-1] in ("num", "str") or words[-1] in (")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return") or (kinds[-1] == "id" and words[-1] not in RESERVED["go"])):
                add("op", ";")
            if notes is not None and kind == "note":
                notes.append((start, word, line))
            line = line or broken
            continue
        if kind == "directive":
            name = re.match(r"[ \t]*#[ \t]*(\w*)", word).group(1)
            if name and name not in _DIRECTIVES:
                raise Bad
            line = True
            continue
        if kind == "op":
            if word == "{":
                depth += 1
            elif word == "}":
                depth -= 1
        add(kind, word)
    if templates:
        raise Bad
    if lang == "go" and kinds and not line and words[-1] not in (";",):
        add("op", ";")
    line = True
    add("eof", "")
    return kinds, words, fresh


class Parser:
    """The core: a cursor over tokens and the expression grammar that the brace languages share."""

    lang = ""

    def __init__(self, tokens: tuple[list[str], list[str], list[bool]]):
        self.kinds, self.words, self.fresh = tokens
        self.reserved, self.binary, self.at = RESERVED[self.lang], BINARY[self.lang], 0
        self.failed: set[tuple[str, int]] = set()

    @property
    def w(self) -> str:
        return self.words[self.at] if self.kinds[self.at] != "str" else ""

    def is_(self, *words: str) -> bool:
        return self.kinds[self.at] not in ("str", "re") and self.words[self.at] in words

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Bad

    def peek(self, n: int = 1) -> str:
        i = self.at + n
        return self.words[i] if i < len(self.words) and self.kinds[i] != "str" else ""

    def is_name(self, n: int = 0) -> bool:
        i = self.at + n
        return i < len(self.kinds) and self.kinds[i] == "id" and self.words[i] not in self.reserved

    def name(self) -> str:
        if not self.is_name():
            raise Bad
        self.at += 1
        return self.words[self.at - 1]

    def attempt(self, rule) -> bool:
        """Runs ``rule``; on failure the cursor goes back. What failed once at a place isn't tried there again, so nested
        attempts don't multiply."""
        at, no_in, literal = self.at, self.no_in, self.literal
        if (rule.__name__, at) in self.failed:
            return False
        try:
            rule()
            return True
        except Bad:
            self.at, self.no_in, self.literal = at, no_in, literal
            self.failed.add((rule.__name__, at))
            return False

    def listed(self, rule, close: str, least: int = 0) -> None:
        """``rule`` separated by commas up to ``close``; a last comma may stand."""
        n = 0
        while not self.is_(close):
            rule()
            n += 1
            if not self.take(","):
                break
        if n < least:
            raise Bad
        self.need(close)

    def end(self) -> None:
        self.need(";")

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.operand()
        while self.is_(*self.binary) and not (self.no_in and self.is_("in")):
            if self.lang == "java" and self.is_(">") and self.peek() == ">":  # shift, lexed apart inside generics
                self.at += 1
            self.at += 1
            self.operand()
        self.after_operand()
        if "?" in OPERATORS[self.lang] and self.take("?"):
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.need(":")
            self.assignment()
        elif self.is_(*_ASSIGN):
            self.at += 1
            self.assignment()

    no_in, literal = False, True  # whether an in ends the expression; whether a composite literal may stand here

    def after_operand(self) -> None:
        pass

    def operand(self) -> None:
        while self.is_("+", "-", "!", "~", "++", "--", *self.prefixes):
            self.at += 1
        self.primary()
        while self.postfix():
            pass

    prefixes: tuple[str, ...] = ()

    def arguments(self) -> None:
        kept, self.no_in = self.no_in, False
        self.listed(self.argument, ")")
        self.no_in = kept

    def argument(self) -> None:
        self.assignment()

    def postfix(self) -> bool:
        if self.take("."):
            self.member()
        elif self.take("["):
            self.expression()
            self.need("]")
        elif self.take("("):
            self.arguments()
        elif self.is_("++", "--") and not self.fresh[self.at]:
            self.at += 1
        else:
            return False
        return True

    def member(self) -> None:
        self.name()

    def block(self) -> None:
        self.need("{")
        while not self.is_("}"):
            self.statement()
        self.at += 1

    def statement(self) -> None:
        raise NotImplementedError

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def common_statement(self) -> bool:
        """The statements that C, Java and JavaScript share."""
        w = self.w if self.kinds[self.at] in ("id", "op") else ""
        if w == "{":
            self.block()
        elif w == ";":
            self.at += 1
        elif w == "if":
            self.at += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif w == "while":
            self.at += 1
            self.condition()
            self.statement()
        elif w == "do":
            self.at += 1
            self.statement()
            self.need("while")
            self.condition()
            self.take(";") if self.lang in ("javascript", "typescript") else self.need(";")
        elif w == "return":
            self.at += 1
            if not self.is_(";", "}") and not (self.fresh[self.at] and self.lang in ("javascript", "typescript")):
                self.expression()
            self.end()
        elif w in ("break", "continue"):
            self.at += 1
            if self.is_name() and not self.fresh[self.at]:
                self.at += 1
            self.end()
        elif w == "throw" and self.lang != "c":
            self.at += 1
            self.expression()
            self.end()
        elif w == "switch":
            self.at += 1
            self.condition()
            self.need("{")
            while not self.take("}"):
                if self.take("default"):
                    self.after_case()
                elif self.take("case"):
                    self.case_label()
                    self.after_case()
                else:
                    self.statement()
        elif w == "try" and self.lang != "c":
            self.at += 1
            resources = self.lang == "java" and self.is_("(")
            if resources:
                self.skip_resources()
            self.block()
            handlers = 0
            while self.take("catch"):
                handlers += 1
                if self.take("("):
                    self.catch_parameter()
                    self.need(")")
                elif self.lang == "java":
                    raise Bad
                self.block()
            if self.take("finally"):
                handlers += 1
                self.block()
            if not handlers and not resources:
                raise Bad
        elif self.is_name() and self.peek() == ":" and self.peek(2) != ":":
            self.at += 2
            self.statement()
        else:
            return False
        return True

    def case_label(self) -> None:
        self.expression()

    def after_case(self) -> None:
        self.need(":")

    def catch_parameter(self) -> None:
        self.name()

    def skip_resources(self) -> None:
        self.need("(")
        self.listed(self.expression, ")")

    def file(self) -> None:
        while self.kinds[self.at] != "eof":
            self.statement()


class Script(Parser):
    """JavaScript modules; ``typed`` adds TypeScript."""

    lang, typed = "javascript", False
    prefixes = ("typeof", "void", "delete", "await", "...")

    def end(self) -> None:
        if not self.take(";") and not self.is_("}") and not self.fresh[self.at] and self.kinds[self.at] != "eof":
            raise Bad

    def member(self) -> None:
        self.take("#")
        if self.kinds[self.at] != "id":
            raise Bad
        self.at += 1

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if not self.take(","):
                    self.take("...")
                    self.binding_default()
        elif self.take("{"):
            self.listed(self.binding_member, "}")
        else:
            self.name()

    def binding_member(self) -> None:
        if self.take("..."):
            self.name()
            return
        self.property_name()
        if self.take(":"):
            self.binding_default()
        elif self.take("="):
            self.assignment()

    def binding_default(self) -> None:
        self.binding()
        if self.take("="):
            self.assignment()

    def parameter(self) -> None:
        if self.typed:
            while self.is_("public", "private", "protected", "readonly", "override") and self.is_name(1):
                self.at += 1
        self.take("...")
        if self.typed and self.take("this"):
            pass
        else:
            self.binding()
        if self.typed:
            self.take("?")
        self.annotation()
        if self.take("="):
            self.assignment()

    def annotation(self) -> None:
        if self.typed and self.take(":"):
            if self.is_("asserts") and self.is_name(1):
                self.at += 1
            self.type_()
            if self.take("is"):
                self.type_()

    def generics(self) -> None:
        if self.typed and self.take("<"):
            self.listed(self.generic, ">", 1)

    def generic(self) -> None:
        self.name()
        if self.take("extends"):
            self.type_()
        if self.take("="):
            self.type_()

    def signature(self) -> None:
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        self.annotation()

    def function(self) -> None:
        self.need("function")
        self.take("*")
        if self.is_name():
            self.at += 1
        self.signature()
        self.body()

    def body(self) -> None:
        if self.typed and not self.is_("{"):
            self.end()
            return
        kept, self.no_in = self.no_in, False
        self.block()
        self.no_in = kept

    def arrow(self) -> None:
        self.take("async")
        if self.is_name() and self.peek() == "=>":
            self.at += 1
        else:
            self.signature()
        if self.fresh[self.at]:
            raise Bad
        self.need("=>")
        self.block() if self.is_("{") else self.assignment()

    def assignment(self) -> None:
        if (self.is_("(", "async", "<") or (self.is_name() and self.peek() == "=>")) and self.attempt(self.arrow):
            return
        if self.take("yield"):
            self.take("*")
            if self.is_(")", "]", "}", ",", ";") or self.fresh[self.at]:
                return
        super().assignment()

    def after_operand(self) -> None:
        while self.typed and self.is_("as", "satisfies") and not self.fresh[self.at]:
            self.at += 1
            if not self.take("const"):
                self.type_()
            while self.is_(*self.binary):
                self.at += 1
                self.operand()

    def primary(self) -> None:
        kind, w = self.kinds[self.at], self.words[self.at]
        if kind in ("num", "str", "re"):
            self.at += 1
        elif w == "`":
            self.template()
        elif w == "(":
            self.at += 1
            kept, self.no_in = self.no_in, False
            self.expression()
            self.no_in = kept
            self.need(")")
        elif w == "[":
            self.at += 1
            while not self.take("]"):
                if not self.take(","):
                    self.assignment()
                    if not self.is_("]"):
                        self.need(",")
        elif w == "{":
            self.at += 1
            self.listed(self.property_, "}")
        elif w == "function" or (w == "async" and self.peek() == "function" and not self.fresh[self.at + 1]):
            self.take("async")
            self.function()
        elif w == "class":
            self.class_()
        elif w == "new":
            self.at += 1
            if self.take("."):
                self.member()
                return
            self.primary()
            while self.is_(".", "["):
                self.postfix()
            if self.typed and self.is_("<"):
                self.attempt(self.type_arguments)
            if self.take("("):
                self.arguments()
        elif w in ("this", "super", "null", "true", "false") and kind == "id":
            self.at += 1
        elif w == "import" and self.peek() in ("(", "."):
            self.at += 1
        elif w == "#":
            self.at += 1
            self.name()
        else:
            self.name()

    def template(self) -> None:
        self.need("`")
        while not self.take("`end"):
            self.need("${")
            self.expression()
            self.need("}$")

    def postfix(self) -> bool:
        if self.is_("`"):
            self.template()
        elif self.take("?."):
            if self.take("("):
                self.arguments()
            elif self.take("["):
                self.expression()
                self.need("]")
            else:
                self.member()
        elif self.typed and self.is_("!") and not self.fresh[self.at]:
            self.at += 1
        elif self.typed and self.is_("<") and self.attempt(self.typed_call):
            pass
        else:
            return super().postfix()
        return True

    def typed_call(self) -> None:
        self.type_arguments()
        self.need("(")
        self.arguments()

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(self.type_, ">", 1)

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.kinds[self.at] in ("id", "str", "num"):
            self.at += 1
        else:
            self.need("#")
            self.name()

    def property_(self) -> None:
        if self.take("..."):
            self.assignment()
            return
        while self.is_("async", "get", "set", "*") and self.peek() not in ("(", ":", ",", "}", "="):
            self.at += 1
        plain = self.is_name()
        self.property_name()
        if self.is_("(", "<"):
            self.signature()
            self.block()
        elif self.take(":"):
            self.assignment()
        elif plain:
            if self.take("="):
                self.assignment()
        else:
            raise Bad

    def class_(self) -> None:
        self.need("class")
        if self.is_name() and not self.is_("implements"):
            self.at += 1
        self.generics()
        if self.take("extends"):
            self.operand()
            if self.typed and self.is_("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.take("}"):
            self.class_member()

    def class_member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.operand()
        words = ("static", "async", "get", "set", "*") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ())
        if self.is_("static") and self.peek() == "{":
            self.at += 1
            self.block()
            return
        while self.is_(*words) and (self.w == "*" or self.peek() not in ("(", "=", ";", ":", "?", "!", "}")):
            self.at += 1
        if self.typed and self.is_("[") and self.attempt(self.index_signature):
            self.end()
            return
        self.property_name()
        if self.typed:
            self.take("?") or self.take("!")
        if self.is_("(", "<"):
            self.signature()
            self.body()
            return
        self.annotation()
        if self.take("="):
            self.assignment()
        self.end()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        self.annotation()

    # types

    def type_(self) -> None:
        self.take("|") or self.take("&")
        self.type_part()
        while self.take("|") or self.take("&"):
            self.type_part()
        if self.is_("extends") and not self.fresh[self.at]:
            self.at += 1
            self.type_()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()

    def type_part(self) -> None:
        if self.is_("keyof", "readonly", "unique", "infer", "typeof") and (self.kinds[self.at + 1] == "id" or self.peek() in ("(", "[", "{")):
            self.at += 1
        kind = self.kinds[self.at]
        if self.take("new"):
            self.function_type()
        elif self.is_("(", "<") and self.attempt(self.function_type):
            return
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):
            self.listed(self.tuple_part, "]")
        elif self.is_("{"):
            self.object_type()
        elif self.is_("`"):
            self.at += 1
            while not self.take("`end"):
                self.need("${")
                self.type_()
                self.need("}$")
        elif kind in ("str", "num"):
            self.at += 1
        elif self.take("-"):
            self.at += 1
        elif self.is_("void", "null", "this", "true", "false", "undefined"):
            self.at += 1
        else:
            self.name()
            while self.take("."):
                self.member()
            if self.is_("<"):
                self.type_arguments()
        while self.is_("[") and not self.fresh[self.at]:
            self.at += 1
            if not self.take("]"):
                self.type_()
                self.need("]")

    def tuple_part(self) -> None:
        self.take("...")
        if self.is_name() and self.peek() in (":", "?"):
            self.at += 1
            self.take("?")
            self.need(":")
        self.type_()
        self.take("?")

    def function_type(self) -> None:
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        self.need("=>")
        self.type_()
        if self.take("is"):
            self.type_()

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.is_("readonly", "get", "set", "+", "-") and self.peek() not in ("(", ":", "?", ";", ",", "}"):
                self.at += 1
            if self.is_("[") and self.is_name(1) and self.peek(2) in (":", "in"):
                self.at += 3
                self.type_()
                if self.take("as"):
                    self.type_()
                self.need("]")
            elif not self.is_("(", "<"):
                self.property_name()
            self.take("-") or self.take("+")
            self.take("?")
            self.signature() if self.is_("(", "<") else self.annotation()
            if not self.take(";") and not self.take(",") and not self.is_("}") and not self.fresh[self.at]:
                raise Bad

    # statements

    def declaration(self) -> None:
        self.at += 1
        while True:
            pattern = self.is_("[", "{")
            self.binding()
            if self.typed:
                self.take("!")
            self.annotation()
            if self.take("="):
                self.assignment()
            elif pattern and not self.is_("of", "in"):
                raise Bad
            if not self.take(","):
                return

    def for_(self) -> None:
        self.need("for")
        self.take("await")
        self.need("(")
        self.no_in = True
        if self.is_("var", "let", "const"):
            self.declaration()
        elif not self.is_(";"):
            self.expression()
        self.no_in = False
        if self.take("of", "in"):
            self.expression()
        else:
            self.need(";")
            if not self.is_(";"):
                self.expression()
            self.need(";")
            if not self.is_(")"):
                self.expression()
        self.need(")")
        self.statement()

    def catch_parameter(self) -> None:
        self.binding()
        self.annotation()

    def module_names(self) -> None:
        if self.kinds[self.at] not in ("id", "str"):
            raise Bad
        self.at += 1
        if self.typed and self.words[self.at - 1] == "type" and self.kinds[self.at] == "id" and not self.is_("as"):
            self.at += 1
        if self.take("as"):
            self.member() if self.kinds[self.at] == "id" else self.string()

    def string(self) -> None:
        if self.kinds[self.at] != "str":
            raise Bad
        self.at += 1

    def source(self) -> None:
        self.need("from")
        self.string()
        if self.take("with") or self.take("assert"):
            self.need("{")
            self.listed(self.property_, "}")
        self.end()

    def import_(self) -> None:
        self.need("import")
        if self.kinds[self.at] == "str":
            self.at += 1
            self.end()
            return
        if self.typed and self.is_("type") and (self.peek() in ("{", "*") or (self.is_name(1) and self.peek() != "from")):
            self.at += 1
        if self.is_name():
            self.at += 1
            if self.typed and self.take("="):
                self.expression()
                self.end()
                return
            if not self.take(","):
                self.source()
                return
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.need("{")
            self.listed(self.module_names, "}")
        self.source()

    def export(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.is_("function", "class", "async", "abstract", "interface"):
                self.statement() if not self.is_("async") or self.peek() == "function" else self.default_value()
            else:
                self.default_value()
        elif self.take("*"):
            if self.take("as"):
                self.member()
            self.source()
        elif self.is_("{") or (self.typed and self.is_("type") and self.peek() == "{"):
            self.take("type")
            self.need("{")
            self.listed(self.module_names, "}")
            self.source() if self.is_("from") else self.end()
        elif self.is_("var", "let", "const", "function", "class", "async") or (self.typed and self.is_("interface", "type", "enum", "namespace", "abstract", "declare", "module")):
            self.statement()
        elif self.typed and self.take("="):
            self.expression()
            self.end()
        else:
            raise Bad

    def default_value(self) -> None:
        self.assignment()
        self.end()

    def typed_statement(self) -> bool:
        follows = self.kinds[self.at + 1] if self.at + 1 < len(self.kinds) else "eof"
        if self.is_("interface") and follows == "id":
            self.at += 1
            self.name()
            self.generics()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.object_type()
        elif self.is_("type") and self.is_name(1) and self.peek(2) in ("=", "<"):
            self.at += 2
            self.generics()
            self.need("=")
            self.type_()
            self.end()
        elif self.is_("enum") or (self.is_("const") and self.peek() == "enum"):
            self.take("const")
            self.need("enum")
            self.name()
            self.need("{")
            self.listed(self.enum_member, "}")
        elif self.is_("declare", "abstract") and follows == "id" and not self.fresh[self.at + 1]:
            self.at += 1
            self.statement()
        elif self.is_("namespace", "module", "global") and (follows == "str" or self.is_name(1)) and not self.fresh[self.at + 1]:
            self.at += 2
            while self.take("."):
                self.name()
            self.block()
        else:
            return False
        return True

    def enum_member(self) -> None:
        self.property_name()
        if self.take("="):
            self.assignment()

    def statement(self) -> None:
        if self.kinds[self.at] == "id":
            if self.typed and self.typed_statement():
                return
            if self.is_("var", "const") or (self.is_("let") and (self.is_name(1) or self.peek() in ("[", "{"))):
                self.declaration()
                self.end()
                return
            if self.is_("function") or (self.is_("async") and self.peek() == "function"):
                self.take("async")
                if not (self.peek() == "*" or self.is_name(1) or self.words[self.at - 2 : self.at - 1] == ["default"] or self.words[self.at - 1 : self.at] == ["default"]):
                    raise Bad
                self.function()
                return
            if self.is_("class"):
                self.class_()
                return
            if self.is_("for"):
                self.for_()
                return
            if self.is_("import") and self.peek() not in ("(", "."):
                self.import_()
                return
            if self.is_("export"):
                self.export()
                return
            if self.take("debugger"):
                self.end()
                return
        elif self.is_("@"):
            self.at += 1
            self.operand()
            return
        if not self.common_statement():
            self.expression()
            self.end()


class TypedScript(Script):
    lang, typed = "typescript", True


class CFamily(Parser):
    """What Java and C share: declarations begin with a type, statements end with a semicolon."""

    def for_(self) -> None:
        self.need("for")
        self.need("(")
        if not self.is_(";") and not self.attempt(self.local):
            self.expression()
        if self.lang == "java" and self.take(":"):
            self.expression()
        else:
            self.need(";")
            if not self.is_(";"):
                self.expression()
            self.need(";")
            if not self.is_(")"):
                self.expression()
        self.need(")")
        self.statement()

    def expression_statement(self) -> None:
        start = self.at
        self.assignment() if self.lang == "java" else self.expression()
        if self.lang == "java":
            words, kinds = self.words[start : self.at], self.kinds[start : self.at]
            if words[-1] not in (")", "++", "--") and not any(w in _ASSIGN and k == "op" for w, k in zip(words, kinds)) and words[0] not in ("++", "--", "new"):
                raise Bad
        self.end()

    def local(self) -> None:
        raise NotImplementedError

    def local_statement(self) -> None:
        self.local()
        self.end()


class Java(CFamily):
    lang = "java"
    _PRIMITIVE = ("int", "long", "short", "byte", "char", "float", "double", "boolean")
    _MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed")

    def annotations(self) -> None:
        while self.is_("@") and self.peek() != "interface":
            self.at += 1
            self.qualified()
            if self.take("("):
                self.listed(self.annotation_value, ")")

    def annotation_value(self) -> None:
        if self.is_name() and self.peek() == "=":
            self.at += 2
        self.initial()

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def type_(self) -> None:
        self.annotations()
        if self.is_(*self._PRIMITIVE):
            self.at += 1
        else:
            self.name()
            self.type_arguments()
            while self.is_(".") and self.is_name(1):
                self.at += 1
                self.name()
                self.type_arguments()
        self.dimensions()

    def dimensions(self) -> None:
        while self.is_("[") and self.peek() == "]":
            self.at += 2

    def type_arguments(self) -> None:
        if self.is_("<"):
            self.at += 1
            if not self.is_(">"):
                self.type_argument()
                while self.take(","):
                    self.type_argument()
            self.close_angle()

    def close_angle(self) -> None:
        """A ``>``; a longer operator gives off its first sign."""
        w = self.w
        if w in (">>", ">>>"):
            self.words[self.at] = w[1:]
        else:
            self.need(">")

    def type_argument(self) -> None:
        self.annotations()
        if self.take("?"):
            if self.take("extends", "super"):
                self.type_()
        else:
            self.type_()

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.name()
                if self.take("extends"):
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.close_angle()

    def modifiers(self) -> None:
        while True:
            self.annotations()
            if self.is_("non") and self.peek() == "-":
                self.at += 3
            elif self.is_("sealed", "default") and self.peek() in ("(", ":", "->"):
                return
            elif self.is_(*self._MODIFIERS):
                self.at += 1
            else:
                return

    def file(self) -> None:
        self.attempt(self.package)
        while self.take(";") or self.is_("import"):
            if self.take("import"):
                self.take("static")
                self.name()
                while self.take("."):
                    if self.take("*"):
                        break
                    self.name()
                self.end()
        while self.kinds[self.at] != "eof":
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def package(self) -> None:
        self.annotations()
        self.need("package")
        self.qualified()
        self.end()

    def is_type_declaration(self) -> bool:
        return self.is_("class", "interface", "enum") or (self.is_("@") and self.peek() == "interface") or (self.is_("record") and self.is_name(1) and self.peek(2) in ("(", "<"))

    def type_declaration(self) -> None:
        if not self.is_type_declaration():
            raise Bad
        kind = self.w
        self.take("@")
        self.at += 1
        self.name()
        self.type_parameters()
        if kind == "record":
            self.need("(")
            self.listed(self.parameter, ")")
        while self.take("extends", "implements", "permits"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        if kind == "enum":
            while self.is_name() or self.is_("@"):
                self.annotations()
                self.name()
                if self.take("("):
                    self.arguments()
                if self.is_("{"):
                    self.members()
                if not self.take(","):
                    break
            if self.take("}"):
                return
            self.need(";")
        self.at -= 1
        self.members(opened=True)

    def members(self, opened: bool = False) -> None:
        self.at += 1
        if not opened and self.words[self.at - 1] != "{":
            raise Bad
        while not self.take("}"):
            self.class_member()

    def class_member(self) -> None:
        if self.take(";"):
            return
        if self.is_("{") or (self.is_("static") and self.peek() == "{"):
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.is_type_declaration():
            self.type_declaration()
            return
        self.type_parameters()
        if self.is_name() and self.peek() in ("(", "{"):
            self.at += 1
            if self.is_("{"):
                self.block()
                return
        else:
            self.take("void") or self.type_()
            self.name()
        if not self.take("("):
            self.declarators()
            self.end()
            return
        self.listed(self.parameter, ")")
        self.dimensions()
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()
        if self.take("default"):
            self.initial()
        self.block() if self.is_("{") else self.end()

    def parameter(self) -> None:
        self.modifiers()
        self.type_()
        self.take("...")
        self.take("this") or self.name()
        self.dimensions()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.name()

    def initial(self) -> None:
        if self.take("{"):
            self.listed(self.initial, "}")
        elif self.is_("@"):
            self.annotations()
        else:
            self.assignment()

    def local(self) -> None:
        self.modifiers()
        self.type_()
        self.name()
        if not self.is_("=", ";", ",", ":", "["):
            raise Bad
        self.declarators()

    def catch_parameter(self) -> None:
        self.modifiers()
        self.type_()
        while self.take("|"):
            self.type_()
        self.name()

    def skip_resources(self) -> None:
        self.need("(")
        while not self.take(")"):
            if not self.attempt(self.local):
                self.expression()
            if not self.is_(")"):
                self.need(";")

    def statement(self) -> None:
        if self.is_("for"):
            self.for_()
        elif self.is_("synchronized") and self.peek() == "(":
            self.at += 1
            self.condition()
            self.block()
        elif self.take("assert"):
            self.expression()
            if self.take(":"):
                self.expression()
            self.end()
        elif self.is_("yield") and self.peek() not in ("=", ".", "("):
            self.at += 1
            self.expression()
            self.end()
        elif self.common_statement():
            pass
        elif self.is_type_declaration() or self.is_("abstract", "static") or (self.is_("final", "@") and self.attempt(self.local_type)):
            if self.is_type_declaration() or self.is_("abstract", "static"):
                self.local_type()
        elif not self.attempt(self.local_statement):
            self.expression_statement()

    def pattern(self) -> None:
        self.take("final")
        self.type_()
        if self.take("("):
            self.listed(self.pattern, ")")
            if self.is_name() and not self.is_("when"):
                self.at += 1
        else:
            self.name()

    def case_label(self) -> None:
        while True:
            if not self.take("default") and not self.attempt(self.pattern):
                Parser.assignment(self)  # a name before an arrow is no lambda here
            if not self.take(","):
                break
        if self.take("when"):
            Parser.assignment(self)

    def after_case(self) -> None:
        if self.take(":"):
            return
        self.need("->")
        if self.is_("{", "throw"):
            self.statement()
        else:
            self.expression()
            self.end()

    def local_type(self) -> None:
        self.modifiers()
        self.type_declaration()

    def lambda_(self) -> None:
        if self.is_name() and self.peek() == "->":
            self.at += 1
        else:
            self.need("(")
            self.listed(lambda: self.name() if self.is_name() and self.peek() in (",", ")") else self.parameter(), ")")
        self.need("->")
        self.block() if self.is_("{") else self.assignment()

    def assignment(self) -> None:
        if (self.is_("(") or (self.is_name() and self.peek() == "->")) and self.attempt(self.lambda_):
            return
        super().assignment()

    def after_operand(self) -> None:
        while self.take("instanceof"):
            self.take("final")
            self.type_()
            if self.take("("):
                self.listed(self.parameter, ")")
            elif self.is_name():
                self.at += 1
            while self.is_(*self.binary):
                self.at += 1
                self.operand()

    def cast(self) -> None:
        self.need("(")
        primitive = self.is_(*self._PRIMITIVE)
        self.type_()
        while self.take("&"):
            self.type_()
        self.need(")")
        if not primitive and (self.is_("+", "-", "++", "--", ")", ";", ",", "]", ".", "?", ":", "*", "/", "==", "&&", "||") or self.kinds[self.at] == "eof"):
            raise Bad
        if self.is_("(") or (self.is_name() and self.peek() == "->"):
            if self.attempt(self.lambda_):
                return
        self.operand()

    def primary(self) -> None:
        kind, w = self.kinds[self.at], self.words[self.at]
        if kind in ("num", "str"):
            self.at += 1
        elif w == "(":
            if self.attempt(self.cast):
                return
            self.at += 1
            self.expression()
            self.need(")")
        elif w == "new":
            self.at += 1
            self.annotations()
            self.take(*self._PRIMITIVE) or self.qualified_type()
            if self.is_("["):
                while self.take("["):
                    if not self.is_("]"):
                        self.expression()
                    self.need("]")
                if self.is_("{"):
                    self.initial()
            else:
                self.need("(")
                self.arguments()
                if self.is_("{"):
                    self.members()
        elif w in ("this", "super", "null", "true", "false"):
            self.at += 1
        elif w == "switch":
            self.common_statement()
        elif w in self._PRIMITIVE or w == "void":
            self.at += 1
            self.dimensions()
            if not self.is_(".", "::"):
                raise Bad
        else:
            self.name()
            if self.is_("<"):
                self.attempt(self.generic_reference)
            self.is_("[") and self.peek() == "]" and self.dimensions()

    def generic_reference(self) -> None:
        self.type_arguments()
        if not self.is_("::"):
            raise Bad

    def qualified_type(self) -> None:
        self.name()
        self.type_arguments()
        while self.take("."):
            self.name()
            self.type_arguments()

    def postfix(self) -> bool:
        if self.take("::"):
            self.take("new") or self.name()
            return True
        return super().postfix()

    def member(self) -> None:
        self.type_arguments()
        if not self.take("class", "this", "super"):
            if self.is_("new"):
                self.primary()
            else:
                self.name()


class C(CFamily):
    lang = "c"
    prefixes = ("*", "&")
    _TYPES = ("void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "_Complex", "struct", "union", "enum")
    _SPECIFIERS = ("static", "extern", "typedef", "register", "auto", "inline", "const", "volatile", "restrict", "_Noreturn", "_Thread_local", "_Atomic")

    def specifiers(self) -> None:
        """At least one type: built in, a tag, or one name."""
        typed = False
        while True:
            if self.is_(*self._SPECIFIERS):
                self.at += 1
            elif self.is_("struct", "union", "enum"):
                kind = self.w
                self.at += 1
                named = self.is_name()
                if named:
                    self.at += 1
                if self.take("{"):
                    if kind == "enum":
                        self.listed(self.enumerator, "}", 1)
                    else:
                        while not self.take("}"):
                            self.declaration()
                elif not named:
                    raise Bad
                typed = True
            elif self.is_(*self._TYPES):
                self.at += 1
                typed = True
            elif not typed and self.is_name():
                if self.words[self.at] in ("__attribute__", "__extension__"):
                    self.at += 1
                    if self.take("("):
                        self.arguments()
                    continue
                self.at += 1
                typed = True
            else:
                break
        if not typed:
            raise Bad

    def enumerator(self) -> None:
        self.name()
        if self.take("="):
            self.assignment()

    def declarator(self, abstract: bool = False) -> bool:
        """Whether it ends as a function's."""
        while self.take("*", "const", "volatile", "restrict"):
            pass
        if self.is_("(") and (self.peek() == "*" or (self.is_name(1) and self.peek(2) == ")")):
            self.at += 1
            self.declarator(abstract)
            self.need(")")
        elif self.is_name():
            self.at += 1
        elif not abstract:
            raise Bad
        function = False
        while True:
            if self.take("["):
                self.take("static")
                if not self.is_("]"):
                    self.assignment()
                self.need("]")
                function = False
            elif self.take("("):
                self.listed(self.parameter, ")")
                function = True
            else:
                return function

    def parameter(self) -> None:
        if not self.take("..."):
            self.specifiers()
            self.declarator(abstract=True)

    def initial(self) -> None:
        if self.take("{"):
            self.listed(self.element, "}")
        else:
            self.assignment()

    def element(self) -> None:
        designated = False
        while self.is_(".", "["):
            designated = True
            if self.take("."):
                self.name()
            else:
                self.at += 1
                self.assignment()
                self.need("]")
        if designated:
            self.need("=")
        self.initial()

    def declaration(self, top: bool = False) -> None:
        if self.take("_Static_assert"):
            self.need("(")
            self.arguments()
            self.end()
            return
        self.specifiers()
        if self.take(";"):
            return
        first = True
        while True:
            function = self.declarator() if not self.is_(":") else False
            if self.take(":"):
                self.assignment()
            if first and top and function and self.is_("{"):
                self.block()
                return
            if self.take("="):
                self.initial()
            first = False
            if not self.take(","):
                break
        self.end()

    def local(self) -> None:
        if not self.is_(*self._TYPES, *self._SPECIFIERS) and not (self.is_name() and (self.is_name(1) or (self.peek() == "*" and self.is_name(2) and self.peek(3) in ("=", ";", ",", "[")) or self.peek() == "*" and self.peek(2) == "*")):
            raise Bad
        self.specifiers()
        while True:
            self.declarator()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return

    def local_declaration(self) -> None:
        if self.is_("struct", "union", "enum", "_Static_assert"):
            self.declaration()
        else:
            self.local_statement()

    def statement(self) -> None:
        if self.is_("for"):
            self.for_()
        elif self.take("goto"):
            self.name()
            self.end()
        elif not self.common_statement() and not self.attempt(self.local_declaration):
            self.expression_statement()

    def file(self) -> None:
        while self.kinds[self.at] != "eof":
            if not self.take(";"):
                self.declaration(top=True)

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(abstract=True)

    def cast(self) -> None:
        self.need("(")
        named = self.is_name()
        self.type_name()
        self.need(")")
        if self.is_("{"):
            self.initial()
            return
        if named and not (self.is_name() or self.kinds[self.at] in ("num", "str") or self.is_("(", "sizeof", "!", "~")):
            raise Bad
        self.operand()

    def primary(self) -> None:
        kind, w = self.kinds[self.at], self.words[self.at]
        if kind == "str":
            while self.kinds[self.at] == "str":
                self.at += 1
        elif kind == "num":
            self.at += 1
        elif w in ("sizeof", "_Alignof"):
            self.at += 1
            if not (self.is_("(") and self.attempt(self.sized_type)):
                self.operand()
        elif w == "(":
            if self.attempt(self.cast):
                return
            self.at += 1
            self.expression()
            self.need(")")
        else:
            self.name()

    def sized_type(self) -> None:
        self.need("(")
        self.type_name()
        self.need(")")

    def postfix(self) -> bool:
        if self.take("->"):
            self.name()
            return True
        return super().postfix()


class Go(Parser):
    lang = "go"
    prefixes = ("*", "&", "<-", "^")

    def end(self) -> None:
        if not self.is_(")", "}"):
            self.need(";")

    def file(self) -> None:
        while self.take(";"):
            pass
        if self.kinds[self.at] == "eof" and self.at == 0:
            return
        self.need("package")
        self.name()
        self.need(";")
        while self.is_("import"):
            self.at += 1
            self.grouped(self.import_)
            self.need(";")
        while self.kinds[self.at] != "eof":
            self.top()
            self.need(";")

    def grouped(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                self.end()
        else:
            rule()

    def import_(self) -> None:
        if not self.take("."):
            if self.is_name():
                self.at += 1
        if self.kinds[self.at] != "str":
            raise Bad
        self.at += 1

    def top(self) -> None:
        if self.is_("func"):
            self.at += 1
            if self.take("("):
                self.parameters()
            self.name()
            if self.take("["):
                self.parameters("]")
            self.signature()
            if self.is_("{"):
                self.body()
        else:
            self.declaration()

    def declaration(self) -> None:
        if self.take("var"):
            self.grouped(self.variable)
        elif self.take("const"):
            self.grouped(self.constant)
        elif self.take("type"):
            self.grouped(self.type_spec)
        else:
            raise Bad

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def expressions(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def variable(self) -> None:
        self.names()
        if not self.is_("="):
            self.type_()
        if self.take("="):
            self.expressions()

    def constant(self) -> None:
        self.names()
        if not self.is_("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.is_("[") and self.is_name(1) and self.peek(2) != "]":
            self.attempt(self.type_parameters)
        self.take("=")
        self.type_()

    def type_parameters(self) -> None:
        self.need("[")
        self.parameters("]")

    def parameters(self, close: str = ")") -> None:
        self.listed(self.parameter, close)

    def parameter(self) -> None:
        if self.is_name() and not (self.peek() in (",", ")", ".", "]")):
            self.at += 1
            if self.is_("[") and self.attempt(self.instance):
                return
        if self.is_name() and self.peek() in (",", ")", "]"):
            self.at += 1
            return
        self.take("...")
        self.type_()
        while self.take("|"):
            self.take("~")
            self.type_()

    def instance(self) -> None:
        self.need("[")
        self.listed(self.type_, "]", 1)
        if not self.is_(",", ")"):
            raise Bad

    def signature(self) -> None:
        self.need("(")
        self.parameters()
        if self.take("("):
            self.parameters()
        elif self.is_name() or self.is_("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type_()

    def type_(self) -> None:
        self.take("~")
        if self.take("*"):
            self.type_()
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):
            if not self.take("]"):
                self.take("...") or self.assignment()
                self.need("]")
            self.type_()
        elif self.take("map"):
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif self.take("<-"):
            self.need("chan")
            self.type_()
        elif self.take("chan"):
            self.take("<-")
            self.type_()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.need("{")
            while not self.take("}"):
                self.field()
                self.end()
        elif self.take("interface"):
            self.need("{")
            while not self.take("}"):
                if self.is_name() and self.peek() == "(":
                    self.at += 1
                    self.signature()
                else:
                    self.type_()
                    while self.take("|"):
                        self.type_()
                self.end()
        else:
            self.name()
            if self.take("."):
                self.name()
            if self.is_("[") and (self.is_name(1) or self.peek() in ("*", "[", "map")):
                self.attempt(self.type_instance)

    def type_instance(self) -> None:
        self.need("[")
        self.listed(self.type_, "]", 1)

    def field(self) -> None:
        if self.is_("*") or (self.is_name() and (self.peek() in (";", "}", ".") or self.kinds[self.at + 1] == "str")):
            self.type_()
        else:
            self.names()
            self.type_()
        if self.kinds[self.at] == "str":
            self.at += 1

    def body(self) -> None:
        kept, self.literal = self.literal, True
        self.block()
        self.literal = kept

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.is_("}", "case", "default"):
            self.statement()
            self.end()

    def simple(self) -> None:
        if self.take("range"):
            self.assignment()
            return
        self.expressions()
        if self.is_("++", "--"):
            self.at += 1
        elif self.is_(*_ASSIGN):
            self.at += 1
            self.take("range")
            self.expressions()
        elif self.take("<-"):
            self.assignment()

    def assignment(self) -> None:
        self.operand()
        while self.is_(*self.binary):
            self.at += 1
            self.operand()

    def postfix(self) -> bool:
        if self.take("."):
            if self.take("("):
                self.take("type") or self.type_()
                self.need(")")
            else:
                self.name()
        elif self.take("["):
            kept, self.literal = self.literal, True
            while not self.take("]"):
                if not self.take(":", ","):
                    self.type_value()
            self.literal = kept
        elif self.take("("):
            kept, self.literal = self.literal, True
            self.listed(self.argument, ")")
            self.literal = kept
        elif self.is_("{") and self.literal and self.may_be_literal():
            self.composite()
        else:
            return False
        return True

    def may_be_literal(self) -> bool:
        before = self.words[self.at - 1]
        return (self.kinds[self.at - 1] == "id" and before not in self.reserved) or before == "]"

    def argument(self) -> None:
        self.type_value()
        self.take("...")

    def type_value(self) -> None:
        """A value, or a type as make and new take it."""
        if self.is_("map", "chan", "struct", "interface", "[", "*", "func"):
            at = self.at
            try:
                self.assignment()
                return
            except Bad:
                self.at = at
                self.type_()
        else:
            self.assignment()

    def composite(self) -> None:
        self.need("{")
        kept, self.literal = self.literal, True
        self.listed(self.element, "}")
        self.literal = kept

    def element(self) -> None:
        self.element_value()
        if self.take(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.is_("{"):
            self.composite()
        else:
            self.assignment()

    def primary(self) -> None:
        kind, w = self.kinds[self.at], self.words[self.at]
        if kind in ("num", "str"):
            self.at += 1
        elif w == "(":
            self.at += 1
            kept, self.literal = self.literal, True
            self.type_value()
            self.literal = kept
            self.need(")")
        elif w == "func":
            self.at += 1
            self.signature()
            self.body()
        elif w in ("[", "map", "struct"):
            self.type_()
            if self.is_("("):
                return
            self.composite()
        elif w in ("chan", "interface"):
            self.type_()
        else:
            self.name()

    def header(self) -> None:
        """Of if, for and switch, up to the brace."""
        kept, self.literal = self.literal, False
        while not self.is_("{"):
            if not self.take(";"):
                self.simple()
                if not self.is_("{", ";"):
                    raise Bad
        self.literal = kept

    def statement(self) -> None:
        w = self.w if self.kinds[self.at] in ("id", "op") else ""
        if w in ("var", "const", "type"):
            self.declaration()
        elif w == "{":
            self.block()
        elif w == ";":
            pass
        elif w == "if":
            self.at += 1
            if self.is_("{"):
                raise Bad
            self.header()
            self.block()
            if self.take("else"):
                self.statement() if self.is_("if") else self.block()
        elif w == "for":
            self.at += 1
            self.header()
            self.block()
        elif w in ("switch", "select"):
            self.at += 1
            self.header()
            self.need("{")
            while not self.take("}"):
                if not self.take("default"):
                    self.need("case")
                    self.case()
                self.need(":")
                self.statements()
        elif w == "return":
            self.at += 1
            if not self.is_(";", "}"):
                self.expressions()
        elif w in ("break", "continue", "goto", "fallthrough"):
            self.at += 1
            if self.is_name():
                self.at += 1
        elif w in ("go", "defer"):
            self.at += 1
            self.assignment()
            if self.words[self.at - 1] != ")":
                raise Bad
        elif self.is_name() and self.peek() == ":":
            self.at += 2
            if not self.is_("}"):
                self.statement()
        else:
            start = self.at
            self.simple()
            words, kinds = self.words[start : self.at], self.kinds[start : self.at]
            if words[-1] not in (")", "++", "--") and not any(k == "op" and (w in _ASSIGN or w == "<-") for w, k in zip(words, kinds)):
                raise Bad

    def case(self) -> None:
        self.type_value()
        while self.take(","):
            self.type_value()
        if self.is_(*_ASSIGN, "<-"):
            self.at += 1
            self.expressions()


_PARSERS = {"javascript": Script, "typescript": TypedScript, "java": Java, "go": Go, "c": C}
# Words that speak for a language, for ranking the grammars.
_SIGNS = {
    "python": "def elif None self import from lambda pass raise except True False in not print".split(),
    "javascript": "const let function console export import async await class from undefined".split(),
    "typescript": "interface number string const let export function private readonly boolean console".split(),
    "java": "package import public class static final String System void private protected long int".split(),
    "go": "package func fmt struct defer type range nil import int var".split(),
    "c": "include int void static struct const printf puts char putchar sizeof".split(),
}
_WORD = re.compile(r"[A-Za-z_]\w*")


_latest: list = [None, None]


def _tokens(language: str, text: str) -> tuple[list[str], list[str], list[bool]]:
    """JavaScript and TypeScript have the same tokens; the latest text's are kept for the other of the two."""
    if language not in ("javascript", "typescript"):
        return _lex(language, text)
    if _latest[0] != text:
        _latest[:] = text, None
        try:
            _latest[1] = _lex(language, text)
        except Bad:
            pass
    if _latest[1] is None:
        raise Bad
    kinds, words, fresh = _latest[1]
    return list(kinds), list(words), list(fresh)


def judged(language: str, text: str | None) -> bool | None:
    """Whether ``text`` is syntactically valid; a byte order mark or emptiness is no fault. Null where nesting is deeper than
    the interpreter's memory can follow."""
    text = (text or "").removeprefix("\ufeff")
    if not text.strip():
        return True
    if language == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "file", "exec", dont_inherit=True)
            return True
        except (SyntaxError, ValueError, OverflowError):
            return False
        except (RecursionError, MemoryError):
            return None
    if language in ("javascript", "typescript") and text.startswith("#!"):
        text = text[len(text.split("\n", 1)[0]) :]
    try:
        tokens = _tokens(language, text)
        room = min(2000 + FRAMES_A_TOKEN * len(tokens[0]), MOST_FRAMES)
        if sys.getrecursionlimit() < room:
            sys.setrecursionlimit(room)
        _PARSERS[language](tokens).file()
        return True
    except (Bad, IndexError):
        return False
    except (RecursionError, MemoryError):
        return None


def valid(language: str, text: str | None) -> bool:
    """Whether ``text`` is known to be valid."""
    return judged(language, text) is True


def ranked(text: str) -> list[str]:
    """The languages, those whose words the text uses most first."""
    words = Counter(_WORD.findall(text))
    counts = {lang: sum(words[w] for w in signs) for lang, signs in _SIGNS.items()}
    return sorted(LANGUAGES, key=lambda lang: (-counts[lang], lang))
