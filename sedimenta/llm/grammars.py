"""Lexers and parsing-expression grammars of the languages that are checked for syntax.

A lexer returns the token string for a Grammar and a function that finds the source offset of a token. Text it can't read becomes the
error class, which no rule accepts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

from sedimenta.llm.peg import ERROR, Grammar

_CACHE = 100_000


class Lexer:
    """pattern: one alternative per token, without groups, white space included; classify: text -> names of classes or literals,
    separated by spaces, '' to leave the token out, None for an error. finish may drop and insert tokens; inserted are those of virtual."""

    line_end, virtual = "", ""

    def __init__(self, grammar: Grammar, pattern: str, classify: Callable[[str], str | None]):
        self.grammar, self.pattern = grammar, re.compile(pattern, re.S)
        self.classify, self.known = classify, {}

    def symbol(self, text: str) -> str:
        got = self.known.get(text)
        if got is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            g = self.grammar
            if (sym := g.sym.get(text)) is not None:
                got = sym
            else:
                name = self.classify(text)
                got = ERROR if name is None else "".join(g.classes.get(n) or g.sym.get(n) or n for n in name.split(" ") if n)
            self.known[text] = got
        return got

    def __call__(self, source: str) -> tuple[str, frozenset | set]:
        """The token string and the places of tokens that follow a line end."""
        get, symbol = self.known.get, self.symbol
        return self.finish("".join([s if (s := get(t)) is not None else symbol(t) for t in self.pattern.findall(source)]))

    def finish(self, s: str) -> tuple[str, frozenset | set]:
        return s, frozenset()

    def offset(self, source: str, n: int) -> int:
        """Source offset of the token at place n of the token string."""
        k = sum(c not in self.virtual for c in self(source)[0][:n])
        for m in self.pattern.finditer(source):
            k -= sum(c != self.line_end and not "\uf000" <= c for c in self.symbol(m.group()))
            if k < 0:
                return m.start()
        return len(source)


_STRING = r'"(?:[^"\\\n]|\\.)*"'
_CHAR = r"'(?:[^'\\\n]|\\.)*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*\*/"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)"
_NAMEISH = re.compile(r"[^\W\d][\w$]*|[$#@]?[^\W\d][\w$]*")


def _plain(text: str) -> str | None:
    c = text[0]
    if c.isspace():
        return ""
    if c.isalpha() or c in "_$":
        return "NAME"
    if c.isdigit() or (c == "." and len(text) > 1 and text[1].isdigit()):
        return "NUM"
    if c == "\ufeff" and len(text) == 1:
        return ""
    return None


# ---- JSON

JSON = Grammar(
    r"""
    file <- value
    value <- STR / NUM / object / array
    object <- '{' ( STR ':' value ( ',' STR ':' value )* )? '}'
    array <- '[' ( value ( ',' value )* )? ']'
    """,
    "STR NUM",
)
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"')
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _json_token(text: str) -> str | None:
    if text[0] in " \t\r\n":
        return "" if not text.strip(" \t\r\n") else None
    if text[0] == '"':
        return "STR" if _JSON_STRING.fullmatch(text) else None
    if text in ("true", "false", "null") or _JSON_NUMBER.fullmatch(text):
        return "NUM"
    return None


def json_lexer() -> Lexer:
    return Lexer(JSON, r'"(?:[^"\\]|\\.)*"|[-+\w.]+|\s+|.', _json_token)


# ---- JavaScript and TypeScript

_JS_COMMON = r"""
file <- 'hashbang'? item*
item <- import / export / stmt
import <- 'import' !( '(' / '.' ) ( STR / importclause 'from' STR ) attributes? end
importclause <- typeonly? ( NAME ( ',' ( star / named ) )? / star / named )
star <- '*' 'as' NAME
named <- '{' ( spec ( ',' spec )* ','? )? '}'
spec <- typeonly? ( word / STR ) ( 'as' ( word / STR ) )?
attributes <- ( 'with' / 'assert' ) object
export <- 'export' ( 'default' ( function / class / tsdefault / expr end ) / '*' ( 'as' ( word / STR ) )? 'from' STR attributes? end
        / typeonly? named ( 'from' STR attributes? )? end / declaration / tsexport )
declaration <- decorators ( variables end / function / class / tsdeclaration )
decorators <- ( '@' member ( '(' args ')' )? )*
end <- ';' / &'}' / EOL / EOF
quick_ <- kind NAME '=' simple_ ';' / NAME ( '.' word )* ( '(' ( simple_ ( ',' simple_ )* )? ')' / ( '=' / ASSIGN ) simple_ ) ';' / 'return' simple_ ';'
stmt <- quick_ / block / ';' / declaration / if / for / while / do / 'continue' jump / 'break' jump / return / 'throw' expr end / try / switch
      / label / 'debugger' end / 'with' '(' expr ')' stmt / !( '{' / 'function' / 'class' ) expr end
block <- '{' item* '}'
jump <- ( !EOL NAME )? end
return <- 'return' ( !EOL expr )? end
if <- 'if' '(' expr ')' stmt ( 'else' stmt )?
while <- 'while' '(' expr ')' stmt
do <- 'do' stmt 'while' '(' expr ')' ';'?
for <- 'for' 'await'? '(' ( ( kind target tstype? / postfix ) ( 'of' / 'in' ) expr / ( variables / expr )? ';' expr? ';' expr? ) ')' stmt
try <- 'try' block ( 'catch' ( '(' target tstype? ')' )? block )? ( 'finally' block )?
switch <- 'switch' '(' expr ')' '{' ( ( 'case' expr / 'default' ) ':' item* )* '}'
label <- NAME ':' stmt
kind <- 'const' / 'let' / 'var' / 'using'
variables <- kind variable ( ',' variable )*
variable <- target '!'? tstype? ( '=' assign )?
target <- NAME / object / array
function <- 'async'? 'function' '*'? NAME? signature ( block / tsnobody )
signature <- tsparams? '(' ( param ( ',' param )* ','? )? ')' tsreturn?
param <- decorators modifier* '...'? ( target / 'this' ) '?'? tstype? ( '=' assign )?
class <- 'abstract'? 'class' ( !( 'extends' / 'implements' ) NAME )? tsparams? ( 'extends' postfix tsargs? )? tsimplements? '{' member_* '}'
member_ <- ';' / 'static' block / decorators modifier* ( accessor / method / tsindex / field )
modifier <- ( 'static' / 'async' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor' ) !( '(' / '=' / ';' / ':' / '?' / '!' / '}' / '<' )
accessor <- ( 'get' / 'set' ) !( '(' / '=' / ';' / ':' / '?' / '!' / '}' / '<' ) key signature ( block / tsnobody )
method <- '*'? key '?'? signature ( block / tsnobody )
field <- key ( '?' / '!' )? tstype? ( '=' assign )? end
key <- word / STR / NUM / PRIVATE / '[' assign ']'
word <- NAME / KEYWORD / 'import' / 'export' / 'default' / 'if' / 'for' / 'while' / 'do' / 'continue' / 'break' / 'return' / 'throw' / 'try'
      / 'switch' / 'case' / 'else' / 'catch' / 'finally' / 'const' / 'var' / 'function' / 'class' / 'extends' / 'new' / 'typeof' / 'void'
      / 'delete' / 'in' / 'instanceof' / 'this' / 'super' / 'null' / 'true' / 'false' / 'debugger' / 'with' / 'enum'
object <- '{' ( property ( ',' property )* ','? )? '}'
property <- '...' assign / accessor / 'async' !( ',' / ':' / '(' / '}' / '=' ) '*'? key signature block / '*'? key signature block
          / key ':' assign / NAME ( '=' assign )?
array <- '[' simple_ ( ',' simple_ )* ']' / '[' ( ','+ / ( '...'? assign ) ( ','+ ( '...'? assign )? )* )? ']'
expr <- assign ( ',' assign )*
assign <- ( ( NAME / 'this' ) ( '.' word )* ( '=' / ASSIGN ) )? simple_ &stop_ / arrow / 'yield' ( '*'? assign )? / ternary ( ( '=' / ASSIGN ) assign )?
arrow <- 'async'? ( NAME '=>' / signature '=>' ) ( block / assign )
operand_ <- NAME ( ( '.' / '?.' ) word )* / literal ( '.' word )*
sign_ <- PREFIX / PLUSMINUS / '!' / 'typeof' / 'void'
simple_ <- sign_* operand_ ( operator sign_* operand_ )*
stop_ <- ')' / ']' / '}' / ',' / ';' / ':'
ternary <- binary ( '?' assign ':' assign )?
binary <- unary ( operator unary / tsas )*
operator <- BINARY / PLUSMINUS / '*' / '/' / '|' / '&' / '<' / '>' ( '>' '>'? )? '='? / 'in' / 'instanceof'
unary <- ( PREFIX / PLUSMINUS / CREMENT / '!' / 'typeof' / 'void' / 'delete' / 'await' )* postfix ( !EOL CREMENT )?
postfix <- member
member <- primary ( '.' ( word / PRIVATE ) / '?.' ( word / PRIVATE / '[' expr ']' / tsargs? '(' args ')' / TEMPLATE ) / '[' expr ']' / '(' args ')'
        / TEMPLATE / tsbang / tsargs &( '(' / TEMPLATE ) )*
args <- simple_ ( ',' simple_ )* &')' / ( '...'? assign ( ',' '...'? assign )* ','? )?
primary <- 'new' ( '.' 'target' / newtarget ) / 'function' '*'? NAME? signature block / 'async' 'function' '*'? NAME? signature block
         / class / 'import' ( '(' args ')' / '.' 'meta' ) / literal / object / array / '(' expr ')' / NAME / PRIVATE
newtarget <- 'new' newtarget / ( NAME / 'this' / '(' expr ')' / class / 'function' NAME? signature block ) ( '.' word / '[' expr ']' )* tsargs? ( '(' args ')' )?
literal <- STR / NUM / REGEX / TEMPLATE / 'this' / 'super' / 'null' / 'true' / 'false'
EOF <- !ANY
"""
_JS_ONLY = r"""
typeonly <- NEVER
tsdefault <- NEVER
tsexport <- NEVER
tsdeclaration <- NEVER
tstype <- NEVER
tsnobody <- NEVER
tsparams <- NEVER
tsreturn <- NEVER
tsimplements <- NEVER
tsindex <- NEVER
tsargs <- NEVER
tsas <- NEVER
tsbang <- NEVER
"""
_TS_ONLY = r"""
typeonly <- 'type' !( 'from' / ',' / '=' )
tsdefault <- tsdeclaration
tsexport <- '=' expr end / 'as' 'namespace' NAME end / 'import' NAME '=' expr end
tsdeclaration <- 'declare' ( 'global' block / ( 'const' / 'let' / 'var' ) NAME tstype? end / 'module' STR block / declaration )
   / 'type' NAME tsparams? '=' type end / 'interface' NAME tsparams? ( 'extends' typelist )? typeobject
   / 'const'? 'enum' NAME '{' ( enumerator ( ',' enumerator )* ','? )? '}' / ( 'namespace' / 'module' ) NAME ( '.' NAME )* block
enumerator <- key ( '=' assign )?
tstype <- ':' type
tsnobody <- end
tsparams <- '<' typeparam ( ',' typeparam )* ','? '>'
typeparam <- ( 'const' / 'in' / 'out' )? NAME ( 'extends' type )? ( '=' type )?
tsreturn <- ':' ( 'asserts'? ( NAME / 'this' ) 'is' type / 'asserts' ( NAME / 'this' ) / type )
tsimplements <- 'implements' typelist
typelist <- type ( ',' type )*
tsindex <- '[' NAME ':' type ']' tstype end
tsargs <- '<' typelist '>'
tsas <- ( 'as' / 'satisfies' ) ( 'const' / type )
tsbang <- '!' !'='
type <- 'abstract'? 'new'? tsparams? '(' ( param ( ',' param )* ','? )? ')' '=>' tsreturntype / uniontype ( 'extends' uniontype '?' type ':' type )?
tsreturntype <- 'asserts'? ( NAME / 'this' ) 'is' type / 'asserts' ( NAME / 'this' ) / type
uniontype <- '|'? '&'? typeunit ( ( '|' / '&' ) typeunit )*
typeunit <- ( 'keyof' / 'readonly' / 'unique' / 'infer' ) typeunit / typeatom ( '[' type? ']' )*
typeatom <- 'typeof' NAME ( '.' word )* tsargs? / 'import' '(' STR ')' ( '.' word )* tsargs? / '(' type ')' / typeobject / tuple / 'asserts'? STR / PLUSMINUS? NUM / TEMPLATE
   / 'null' / 'true' / 'false' / 'void' / 'this' / NAME ( '.' word )* tsargs?
tuple <- '[' ( tupleitem ( ',' tupleitem )* ','? )? ']'
tupleitem <- '...'? ( NAME '?'? ':' )? type '?'?
typeobject <- '{' ( typemember ( ';' / ',' / &'}' / EOL )? )* '}'
typemember <- ( PLUSMINUS? 'readonly' )? '[' NAME 'in' type ( 'as' type )? ']' ( PLUSMINUS? '?' )? tstype?
   / 'readonly'? '[' NAME ':' type ']' tstype / 'new'? signature / ( 'get' / 'set' ) key signature / 'readonly'? key '?'? ( signature / tstype )?
"""
_JS_CLASSES = "NAME STR NUM REGEX TEMPLATE PRIVATE KEYWORD ASSIGN BINARY PREFIX CREMENT NEVER PLUSMINUS"
_JS_SOFT = "as from of async get set static let await target meta using accessor"
_TS_SOFT = " type declare namespace module global interface abstract public private protected readonly override implements keyof unique infer is asserts satisfies out"


JS = Grammar(_JS_COMMON + _JS_ONLY, _JS_CLASSES, _JS_SOFT)
TS = Grammar(_JS_COMMON + _TS_ONLY, _JS_CLASSES, _JS_SOFT + _TS_SOFT)

_JS_REGEX = r"/(?![*/])(?:[^\n/\\\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*"
_BEFORE = r"[(,=:\[!&|?{;+*%~^<>-]"  # a slash after one of these begins a regular expression
_JS_PATTERN = (
    rf"\s+|[A-Za-z_$][\w$]*|\#![^\n]*|{_LINE}|{_BLOCK}"
    rf"|(?=/)(?:(?<={_BEFORE})|(?<={_BEFORE} )|(?<=return )|(?<=typeof )|(?<=case )|(?<=\n))(?<!\+\+ )(?<!-- ){_JS_REGEX}"
    rf"|{_STRING}|{_CHAR}"
    r"|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`\"']|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{[^{}]*\}|`(?:[^`\\]|\\.)*`)*\})*`"
    rf"|#?[^\W\d][\w$]*|\$[\w$]*|{_NUM}n?[\w$]*|\.\.\.|\?\.(?!\d)|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\*\*|==|!=|<=|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|<<|\s+|."
)
_JS_WORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new "
    "null return super switch this throw true try typeof var void while with yield".split()
)


class JsLexer(Lexer):
    """Line ends are kept aside for automatic semicolons; expressions inside templates are parsed on their own."""

    line_end = "\uefff"

    def __init__(self, grammar: Grammar):
        super().__init__(grammar, _JS_PATTERN, self._token)
        self.expression = None

    def finish(self, s: str):
        parts = s.split(self.line_end)
        return "".join(parts), set(accumulate(map(len, parts[:-1])))

    def _token(self, text: str) -> str | None:
        c = text[0]
        if text.startswith("#!"):
            return "hashbang"
        if text.startswith(("//", "/*")) or c.isspace():
            return self.line_end if "\n" in text else ""
        if c in "\"'":
            return "STR" if len(text) > 1 else None
        if c == "`":
            return "TEMPLATE" if len(text) > 1 and self._template(text) else None
        if c == "#":
            return "PRIVATE" if len(text) > 1 else None
        if c == "/" and len(text) > 2:
            return "REGEX"
        if text in _JS_WORDS:
            return text if text in self.grammar.sym else "KEYWORD"
        op = self._op(text)
        if op:
            return op
        if c.isdigit() or (c == "." and len(text) > 1):
            return "NUM" if re.fullmatch(rf"{_NUM}n?", text) else None
        return _plain(text)

    def _op(self, p: str) -> str | None:
        if p in self.grammar.sym:
            return p
        if p in _JS_WORDS:
            return "KEYWORD"
        if p in ("++", "--"):
            return "CREMENT"
        if p in ("+", "-"):
            return "PLUSMINUS"
        if p in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??="):
            return "ASSIGN"
        if p in ("%", "^", "**", "==", "!=", "===", "!==", "<=", "&&", "||", "??", "<<"):
            return "BINARY"
        return "PREFIX" if p == "~" else None

    def _template(self, text: str) -> bool:
        for inner in _embedded(text, "${"):
            if self.expression is None:
                self.expression = self.grammar.parser(start="expr")
            if self.expression(*self(inner)) != -1:
                return False
        return True


def _embedded(text: str, opening: str) -> list[str]:
    """The sources between opening and its closing brace."""
    out, at = [], 1
    while (at := text.find(opening, at)) >= 0:
        if (len(text[:at]) - len(text[:at].rstrip("\\"))) % 2:
            at += len(opening)
            continue
        depth, start = 1, at + len(opening)
        at = start
        for m in re.finditer(rf"{_STRING}|{_CHAR}|`(?:[^`\\]|\\.)*`|[{{}}]", text[start:], re.S):
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if not depth:
                at = start + m.start()
                break
        out.append(text[start:at])
    return out


# ---- Go

GO = Grammar(
    r"""
    file <- 'package' NAME semi ( import semi )* ( top ( semi / EOF ) )*
    semi <- ';' / AUTO
    EOF <- !ANY
    import <- 'import' ( '(' ( spec ( semi / &')' ) )* ')' / spec )
    spec <- ( '.' / NAME )? STR
    top <- 'func' ( '(' param ( ',' param )* ','? ')' / '(' ')' )? NAME typeparams? signature block? / declaration
    declaration <- 'const' group_const / 'var' group_var / 'type' group_type
    group_const <- '(' ( constspec ( semi / &')' ) )* ')' / constspec
    group_var <- '(' ( varspec ( semi / &')' ) )* ')' / varspec
    group_type <- '(' ( typespec ( semi / &')' ) )* ')' / typespec
    constspec <- names ( type? '=' exprs )?
    varspec <- names ( '=' exprs / type ( '=' exprs )? )
    typespec <- NAME typeparams? '='? type
    typeparams <- '[' typeparam ( ',' typeparam )* ','? ']'
    typeparam <- names constraint
    constraint <- ( '~' )? type ( '|' '~'? type )*
    names <- NAME ( ',' NAME )*
    exprs <- expr ( ',' expr )*
    signature <- params ( params / type )?
    params <- '(' ( param ( ',' param )* ','? )? ')'
    param <- NAME '...'? type / '...' type / type
    type <- '*' type / '[' '...'? expr? ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature
          / 'struct' '{' ( field ( semi / &'}' ) )* '}' / 'interface' '{' ( method ( semi / &'}' ) )* '}' / '(' type ')'
          / NAME ( '.' NAME )? ( '[' type ( ',' type )* ']' )?
    field <- ( names type / '*'? NAME ( '.' NAME )? ) STR?
    method <- NAME params ( params / type )? / constraint
    block <- '{' stmts '}'
    stmts <- semi* ( stmt ( semi+ / &'}' / &'case' / &'default' ) )*
    quick_ <- NAME ( '.' NAME )* ( ( ':=' / '=' / ASSIGN ) simple_ / '(' ( simple_ ( ',' simple_ )* )? ')' ) &( AUTO / ';' ) / 'return' simple_ &( AUTO / ';' )
    stmt <- quick_ / declaration / block / 'return' exprs? / if / for / switch / 'select' '{' ( ( 'case' simple / 'default' ) ':' stmts )* '}'
          / ( 'go' / 'defer' ) expr / ( 'break' / 'continue' / 'goto' ) NAME? / 'fallthrough' / NAME ':' !'=' stmt? / simple
    simple <- exprs ( ( '=' / ASSIGN ) exprs / ':=' ( exprs ) / CREMENT / '<-' expr )? 
    if <- 'if' ( simple? ';' )? flat block ( 'else' ( if / block ) )?
    for <- 'for' ( ( flats ( '=' / ASSIGN / ':=' ) )? 'range' flat / ( flatsimple? ';' flat? ';' flatsimple? ) / flat )? block
    flats <- flat ( ',' flat )*
    flatsimple <- flats ( ( '=' / ASSIGN / ':=' ) flats / CREMENT )?
    switch <- 'switch' ( flatsimple? ';' )? ( ( NAME ':=' )? flat )? '{' ( ( 'case' ( type ( ',' type )* &':' / exprs ) / 'default' ) ':' stmts )* '}'
    expr <- simple_ &stop_ / unary ( operator unary )*
    sign_ <- UNIBIN / '!'
    operand_ <- NAME ( '.' NAME )* / STR / NUM
    simple_ <- sign_* operand_ ( operator sign_* operand_ )*
    stop_ <- ')' / ']' / '}' / ',' / ';' / AUTO / ':'
    operator <- BINARY / UNIBIN / '*' / '|'
    unary <- ( UNIBIN / '*' / '<-' / '!' )* primary
    primary <- operand ( '.' ( NAME / '(' ( 'type' / type ) ')' ) / index / call / literal )*
    index <- '[' ( expr ( ',' type )* / ( expr? ':' expr? ( ':' expr )? ) ) ']' / '[' expr? ':' expr? ( ':' expr )? ']' / '[' type ( ',' type )* ']'
    call <- '(' simple_ ( ',' simple_ )* ')' / '(' ( ( type &( ',' / ')' ) / expr ) ( ',' expr )* '...'? ','? )? ')'
    operand <- STR / NUM / 'func' signature block / '(' ( expr / type ) ')' / typed ( literal / '(' expr ','? ')' ) / NAME
    typed <- '[' '...'? expr? ']' type / 'map' '[' type ']' type / 'struct' '{' ( field ( semi / &'}' ) )* '}' / 'chan' type / 'interface' '{' '}'
    literal <- '{' ( element ( ',' element )* ','? )? '}'
    element <- ( ( expr / literal ) ':' )? ( expr / literal )
    flat <- simple_ &( '{' / ';' ) / flatunary ( operator flatunary )*
    flatunary <- ( UNIBIN / '*' / '<-' / '!' )* flatprimary
    flatprimary <- operand ( '.' ( NAME / '(' ( 'type' / type ) ')' ) / index / call )*
    """,
    "NAME STR NUM ASSIGN BINARY UNIBIN CREMENT AUTO",
)
_GO_WORDS = set(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)


class GoLexer(Lexer):
    """Line ends after a token that may end a statement become semicolons."""

    line_end = "\uefff"

    def __init__(self):
        pattern = rf"\s+|[A-Za-z_]\w*|{_LINE}|{_BLOCK}|`[^`]*`|{_STRING}|{_CHAR}|[^\W\d]\w*|{_NUM}i?\w*|\.\.\.|:=|<-|\+\+|--|&\^=|<<=|>>=|&\^|<<|>>|&&|\|\||[-+*/%&|^=!<>]=|\s+|."
        super().__init__(GO, pattern, self._token)
        self.virtual = GO.classes["AUTO"]
        after = [GO.classes[c] for c in ("NAME", "STR", "NUM", "CREMENT")] + [GO.sym[c] for c in (")", "]", "}", "return", "break", "continue", "fallthrough")]
        self.ends = re.compile(f"([{re.escape(''.join(after))}]){self.line_end}+")

    def finish(self, s: str):
        return self.ends.sub(rf"\g<1>{self.virtual}", s + self.line_end).replace(self.line_end, ""), frozenset()

    def _token(self, text: str) -> str | None:
        c = text[0]
        if text.startswith(("//", "/*")) or c.isspace():
            return self.line_end if "\n" in text else ""
        if c in "\"`":
            return "STR" if len(text) > 1 else None
        if c == "'":
            return "NUM" if re.fullmatch(r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[\da-fA-F]{2}|[0-7]{3}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))'", text) else None
        if text in _GO_WORDS:
            return text if text in GO.sym else None
        if text in ("++", "--"):
            return "CREMENT"
        if text in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="):
            return "ASSIGN"
        if text in ("+", "-", "^", "&"):
            return "UNIBIN"
        if text in ("/", "%", "<<", ">>", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">="):
            return "BINARY"
        if c.isdigit() or (c == "." and len(text) > 1):
            return "NUM" if re.fullmatch(rf"{_NUM}i?", text) else None
        return _plain(text)


# ---- Java

JAVA = Grammar(
    r"""
    file <- ( annotation* 'package' name ';' )? ( 'import' 'static'? name ( '.' '*' )? ';' / ';' )* ( type_declaration / ';' )*
    name <- NAME ( '.' NAME )*
    annotation <- '@' !'interface' name ( '(' ( pair ( ',' pair )* / element )? ')' )?
    pair <- NAME '=' element
    element <- annotation / '{' ( element ( ',' element )* )? ','? '}' / ternary
    modifier <- annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient'
       / 'volatile' / 'strictfp' / 'default' / 'sealed' / 'non' PLUSMINUS 'sealed'
    type_declaration <- modifier* ( class / interface / enum / record / '@' 'interface' NAME '{' ( modifier* type NAME '(' ')' ( 'default' element )? ';' / member )* '}' )
    class <- 'class' NAME typeparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? body
    interface <- 'interface' NAME typeparams? ( 'extends' types )? ( 'permits' types )? body
    enum <- 'enum' NAME ( 'implements' types )? '{' ( constant ( ',' constant )* ','? )? ( ';' member* )? '}'
    constant <- annotation* NAME arguments? body?
    record <- 'record' NAME typeparams? parameters ( 'implements' types )? body
    typeparams <- '<' typeparam ( ',' typeparam )* '>'
    typeparam <- annotation* NAME ( 'extends' type ( '&' type )* )?
    types <- type ( ',' type )*
    body <- '{' member* '}'
    member <- ';' / 'static'? block / type_declaration / modifier* ( typeparams? ( method / constructor ) / type declarator ( ',' declarator )* ';' )
    method <- ( 'void' / type ) NAME parameters ( '[' ']' )* throws? ( block / ';' )
    constructor <- NAME ( parameters throws? block / block )
    throws <- 'throws' types
    parameters <- '(' ( parameter ( ',' parameter )* )? ')'
    parameter <- modifier* type '...'? ( NAME / 'this' ) ( '[' ']' )*
    declarator <- NAME ( '[' ']' )* ( '=' ( arrayliteral / expr ) )?
    arrayliteral <- '{' simple_ ( ',' simple_ )* '}' / '{' ( ( arrayliteral / expr ) ( ',' ( arrayliteral / expr ) )* )? ','? '}'
    type <- annotation* ( PRIMITIVE / NAME typeargs? ( '.' annotation* NAME typeargs? )* ) ( '[' ']' )*
    typeargs <- '<' ( typearg ( ',' typearg )* )? '>'
    typearg <- annotation* '?' ( ( 'extends' / 'super' ) type )? / type
    block <- '{' stmt* '}'
    quick_ <- ( PRIMITIVE / NAME ) ( '[' ']' )* NAME '=' simple_ ';' / NAME ( '.' NAME )* ( '(' ( simple_ ( ',' simple_ )* )? ')' / ( '=' / ASSIGN ) simple_ ) ';' / 'return' simple_ ';'
    stmt <- quick_ / block / ';' / local ';' / type_declaration / 'if' '(' expr ')' stmt ( 'else' stmt )? / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'
       / for / 'return' expr? ';' / ( 'break' / 'continue' ) NAME? ';' / 'throw' expr ';' / try / switch / 'synchronized' '(' expr ')' block
       / 'assert' expr ( ':' expr )? ';' / 'yield' expr ';' / NAME ':' stmt / statement_expr ';'
    statement_expr <- CREMENT unary / ternaryhead ( ( '=' / ASSIGN ) expr / CREMENT )? 
    ternaryhead <- primary !( BINARY / '?' )
    local <- modifier* type declarator ( ',' declarator )*
    for <- 'for' '(' ( modifier* type NAME ':' expr / ( local / exprs )? ';' expr? ';' exprs? ) ')' stmt
    exprs <- simple_ ( ',' simple_ )* &')' / expr ( ',' expr )*
    try <- 'try' ( '(' resource ( ';' resource )* ';'? ')' )? block ( 'catch' '(' modifier* type ( '|' type )* NAME ')' block )* ( 'finally' block )?
    resource <- modifier* type NAME '=' expr / expr
    switch <- 'switch' '(' expr ')' '{' case* '}'
    case <- ( 'case' label ( ',' label )* ( 'when' expr )? / 'default' ) ( '->' ( block / 'throw' expr ';' / expr ';' ) / ':' stmt* )
    label <- 'default' / type NAME / ternary
    operand_ <- ( NAME / 'this' ) ( '.' NAME )* / STR / NUM
    sign_ <- PLUSMINUS / '!' / '~'
    simple_ <- sign_* operand_ ( operator sign_* operand_ )*
    stop_ <- ')' / ']' / '}' / ',' / ';' / ':'
    expr <- simple_ &stop_ / lambda / ternary ( ( '=' / ASSIGN ) expr )?
    lambda <- ( NAME / '(' ( parameter ( ',' parameter )* / NAME ( ',' NAME )* )? ')' ) '->' ( block / expr )
    ternary <- binary ( '?' ( lambda / ternary ) ':' ( lambda / ternary ) )?
    binary <- unary ( operator unary / 'instanceof' 'final'? type NAME? )*
    operator <- BINARY / PLUSMINUS / '&' / '|' / '*' / '<' '<'? / '>' ( '>' '>'? )?
    unary <- ( PLUSMINUS / CREMENT / '!' / '~' )* ( cast / primary CREMENT? )
    cast <- '(' PRIMITIVE ( '[' ']' )* ')' unary / '(' type ( '&' type )* ')' ( lambda / &( NAME / STR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'switch' / PRIMITIVE ) unary )
    primary <- atom ( '.' ( 'new' creator / typeargs? ( NAME / 'this' / 'super' / 'class' ) ) / '[' expr ']' / arguments / '::' ( NAME / 'new' ) )*
    atom <- STR / NUM / 'this' / 'super' / 'new' creator / switch / '(' expr ')' / PRIMITIVE ( '[' ']' )* ( '.' 'class' / '::' 'new' ) / 'void' '.' 'class'
       / type &( '::' ) / NAME ( '[' ']' )+ '.' 'class' / NAME
    creator <- annotation* ( PRIMITIVE / NAME typeargs? ( '.' NAME typeargs? )* ) ( arguments body? / ( '[' expr ']' )+ ( '[' ']' )* / ( '[' ']' )+ arrayliteral )
    arguments <- '(' exprs? ')'
    """,
    "NAME STR NUM PRIMITIVE ASSIGN BINARY PLUSMINUS CREMENT",
    "record sealed permits yield when non var",
)
_JAVA_WORDS = set(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new "
    "package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while".split()
)


def _java_token(text: str) -> str | None:
    c = text[0]
    if text.startswith(("//", "/*")) or c.isspace():
        return ""
    if c == '"':
        return "STR" if len(text) > 1 else None
    if c == "'":
        return "NUM" if re.fullmatch(r"'(?:[^'\\\n]|[\ud800-\udbff][\udc00-\udfff]|\\(?:[btnfrs0\\'\"]|[0-3]?[0-7]{1,2}|u+[\da-fA-F]{4}))'", text) else None
    if text in ("int", "long", "short", "byte", "char", "float", "double", "boolean"):
        return "PRIMITIVE"
    if text in ("true", "false", "null"):
        return "NUM"
    if text in _JAVA_WORDS:
        return text if text in JAVA.sym else None
    if text in ("++", "--"):
        return "CREMENT"
    if text in ("+", "-"):
        return "PLUSMINUS"
    if text in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="):
        return "ASSIGN"
    if text in ("/", "%", "^", "&&", "||", "==", "!=", "<=", ">="):
        return "BINARY"
    if c.isdigit() or (c == "." and len(text) > 1):
        return "NUM" if re.fullmatch(rf"{_NUM}[lLfFdD]?", text) else None
    return _plain(text)


def java_lexer() -> Lexer:
    pattern = rf'\s+|[A-Za-z_][\w$]*|{_LINE}|{_BLOCK}|"""(?:[^"\\]|\\.|"(?!""))*"""|{_STRING}|{_CHAR}|[^\W\d][\w$]*|\$[\w$]*|{_NUM}\w*|\.\.\.|->|::|\+\+|--|<<=|>>>=|>>=|&&|\|\||[-+*/%&|^=!<>]=|\s+|.'
    return Lexer(JAVA, pattern, _java_token)


# ---- Rust

RUST = Grammar(
    r"""
    file <- 'hashbang'? innerattr* item*
    innerattr <- '#' '!' tokens
    attr <- '#' tokens
    tokens <- '[' tree* ']' / '{' tree* '}' / '(' tree* ')'
    tree <- tokens / !( '(' / ')' / '[' / ']' / '{' / '}' ) ANY
    item <- attr* ( visibility? ( 'use' usetree ';' / 'mod' NAME ( ';' / '{' innerattr* item* '}' ) / function / 'struct' NAME generics? ( where? '{' fields '}' / '(' tuple ')' where? ';' / ';' )
       / 'enum' NAME generics? where? '{' ( variant ( ',' variant )* ','? )? '}' / 'union' NAME generics? '{' fields '}' / ( 'const' / 'static' ) 'mut'? ( NAME / '_' ) ':' type ( '=' expr )? ';'
       / 'type' NAME generics? ( ':' bounds )? where? ( '=' type )? where? ';' / 'unsafe'? 'auto'? 'trait' NAME generics? ( ':' bounds )? where? '{' innerattr* item* '}'
       / 'unsafe'? 'impl' generics? '!'? type ( 'for' type )? where? '{' innerattr* item* '}' / 'unsafe'? 'extern' ( 'crate' NAME ( 'as' ( NAME / '_' ) )? ';' / STR? '{' item* '}' ) )
       / macro_rules / path '!' ( ( '(' tree* ')' / '[' tree* ']' ) ';' / '{' tree* '}' ) )
    macro_rules <- 'macro_rules' '!' NAME tokens ';'?
    visibility <- 'pub' ( '(' ( 'in' path / 'crate' / 'self' / 'super' ) ')' )? / 'crate' &NAME
    usetree <- ( '::' )? ( usebranch / pathpart ( '::' pathpart )* ( '::' usebranch )? ( 'as' ( NAME / '_' ) )? )
    usebranch <- '*' / '{' ( usetree ( ',' usetree )* ','? )? '}'
    pathpart <- NAME / 'self' / 'super' / 'crate' / 'Self'
    function <- ( 'const' / 'async' / 'unsafe' / 'default' / 'extern' STR? )* 'fn' NAME generics? '(' ( fnparam ( ',' fnparam )* ','? )? ')' ( '->' type )? where? ( block / ';' )
    fnparam <- attr* ( '&' LIFETIME? 'mut'? 'self' / 'mut'? 'self' ( ':' type )? / '...' / pattern ':' type )
    generics <- '<' ( generic ( ',' generic )* ','? )? '>'
    generic <- attr* ( LIFETIME ( ':' LIFETIME? ( '+' LIFETIME )* )? / 'const' NAME ':' type ( '=' ( block / literal ) )? / NAME ( ':' bounds? )? ( '=' type )? )
    where <- 'where' ( ( LIFETIME / ( 'for' generics )? type ) ':' bounds? ( ',' ( LIFETIME / ( 'for' generics )? type ) ':' bounds? )* ','? )?
    bounds <- bound ( '+' bound )* '+'?
    bound <- LIFETIME / '(' bound ')' / '?'? ( 'for' generics )? typepath
    fields <- ( field ( ',' field )* ','? )?
    field <- attr* visibility? NAME ':' type
    tuple <- ( attr* visibility? type ( ',' attr* visibility? type )* ','? )?
    variant <- attr* NAME ( '{' fields '}' / '(' tuple ')' )? ( '=' expr )?
    type <- '&' '&'? LIFETIME? 'mut'? type1 / '&&' LIFETIME? 'mut'? type1 / '*' ( 'const' / 'mut' ) type1 / ( 'impl' / 'dyn' ) bounds / type1 ( '+' bounds )?
    type1 <- '&' LIFETIME? 'mut'? type1 / '*' ( 'const' / 'mut' ) type1 / '(' ( type ( ',' type )* ','? )? ')' / '[' type ( ';' expr )? ']' / '!' / '_' / ( 'impl' / 'dyn' ) bound
       / ( 'for' generics )? ( 'unsafe' / 'extern' STR? )* 'fn' '(' ( ( ( NAME / '_' ) ':' )? type ( ',' ( ( NAME / '_' ) ':' )? type )* ','? )? ')' ( '->' type1 )?
       / '<' type ( 'as' typepath )? '>' ( '::' typeseg )+ / path '!' tokens / typepath
    typepath <- '::'? typeseg ( '::' typeseg )*
    typeseg <- pathpart ( '::'? '<' ( typearg ( ',' typearg )* ','? )? '>' / '(' ( type ( ',' type )* ','? )? ')' ( '->' type1 )? )?
    typearg <- LIFETIME / NAME generics? '=' type / NAME ':' bounds / type / block / '-'? literal
    path <- '::'? pathpart ( '::' ( '<' ( typearg ( ',' typearg )* ','? )? '>' / pathpart ) )*
    block <- LABEL? ( 'unsafe' / 'async' 'move'? / 'const' )? '{' innerattr* stmt* expr? '}'
    quick_ <- 'let' 'mut'? NAME '=' simple_ ';' / NAME ( '::' NAME )* ( '.' NAME )* ( '(' ( simple_ ( ',' simple_ )* )? ')' '?'? / '=' simple_ ) ';' / 'return' simple_ ';'
    stmt <- quick_ / ';' / attr* ( let / statementlike !( '.' / '?' ) ';'? / expr ';' ) / item 
    let <- 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';'
    statementlike <- ( LIFETIME ':' )? ( if / 'match' head '{' innerattr* arm* '}' / 'while' condition block / 'loop' block / 'for' pattern 'in' head block / ( 'unsafe' / 'const' !NAME )? block )
       / path '!' '{' tree* '}'
    if <- 'if' condition block ( 'else' ( if / block ) )?
    condition <- ( 'let' pattern '=' headscrut / headunit ) ( ( '&&' / '||' ) ( 'let' pattern '=' headscrut / headunit ) )*
    headscrut <- headunary ( headop headunary / 'as' type1 )*
    headunit <- head
    arm <- attr* '|'? pattern ( 'if' expr )? '=>' ( statementlike !( '.' / '?' / BINARY / '|' ) ','? / expr ( ',' / &'}' ) )
    pattern <- '|'? pattern1 ( '|' pattern1 )*
    pattern1 <- rangepat / 'ref'? 'mut'? NAME !( '::' / '(' / '{' / '!' / '<' / '..' / '..=' ) ( '@' pattern1 )? / '&' '&'? 'mut'? pattern1 / '&&' 'mut'? pattern1 / '(' ( pattern ( ',' pattern )* ','? )? ')'
       / '[' ( pattern ( ',' pattern )* ','? )? ']' / '..' / '_' / '-'? literal / path ( '!' tokens / '(' ( pattern ( ',' pattern )* ','? )? ')' / '{' ( fieldpat ( ',' fieldpat )* ','? )? '}' )?
    rangepat <- ( '-'? literal / path ) ( '..=' / '..' ) ( '-'? literal / path )? / '..=' ( '-'? literal / path )
    fieldpat <- attr* ( '..' / ( NAME / NUM ) ':' pattern / 'ref'? 'mut'? NAME )
    literal <- STR / NUM / 'true' / 'false'
    operand_ <- ( NAME / 'self' ) ( '::' NAME )* ( '.' NAME )* / literal
    sign_ <- '-' / '!' / '*' / '&' 'mut'?
    simple_ <- sign_* operand_ ( operator sign_* operand_ )*
    stop_ <- ')' / ']' / '}' / ',' / ';'
    expr <- simple_ &stop_ / assignment
    assignment <- range ( ( '=' / ASSIGN ) assignment )?
    range <- ( '..' / '..=' ) binary? / binary ( ( '..' / '..=' ) binary? )?
    binary <- unary ( operator unary / 'as' type1 )*
    operator <- BINARY / '*' / '-' / '+' / '&' / '|' / '&&' / '||' / '<' '<'? / '>' '>'?
    headop <- BINARY / '*' / '-' / '+' / '&' / '|' / '<' '<'? / '>' '>'?
    unary <- ( '-' / '!' / '*' / '&&' 'mut'? / '&' ( 'mut' / 'raw' ( 'const' / 'mut' ) )? )* postfix
    postfix <- primary suffix*
    suffix <- '(' simple_ ( ',' simple_ )* ')' / '.' ( NAME ( '::' '<' ( typearg ( ',' typearg )* ','? )? '>' )? / NUM / 'await' ) / '(' ( expr ( ',' expr )* ','? )? ')' / '[' expr ']' / '?'
    primary <- 'return' expr? / 'break' LIFETIME? expr? / 'continue' LIFETIME? / closure / control / literal / '(' ( expr ( ',' expr )* ','? )? ')' / '[' ( expr ( ';' expr / ( ',' expr )* ','? ) )? ']'
       / path '!' tokens / path '{' ( fieldinit ( ',' fieldinit )* )? ','? ( '..' expr )? '}' / '<' type ( 'as' typepath )? '>' '::' path / path / '_'
    control <- statementlike
    fieldinit <- attr* ( ( NAME / NUM ) ':' expr / NAME ) / '..' expr
    closure <- 'move'? ( '||' / '|' ( closureparam ( ',' closureparam )* ','? )? '|' ) ( '->' type block / expr ) / 'async' 'move'? closure
    closureparam <- pattern1 ( ':' type )?
    head <- simple_ &'{' / headrange
    headrange <- ( '..' / '..=' ) headbinary? / headbinary ( ( '..' / '..=' ) headbinary? )?
    headbinary <- headunary ( ( headop / '&&' / '||' ) headunary / 'as' type1 )*
    headunary <- ( '-' / '!' / '*' / '&&' 'mut'? / '&' 'mut'? )* headprimary suffix*
    headprimary <- closure / control / literal / '(' ( expr ( ',' expr )* ','? )? ')' / '[' ( expr ( ';' expr / ( ',' expr )* ','? ) )? ']' / path '!' tokens / path
    """,
    "NAME STR NUM LIFETIME LABEL ASSIGN BINARY",
    "union auto default macro_rules raw",
)
_RUST_WORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super "
    "trait true type unsafe use where while".split()
)


def _rust_token(text: str) -> str | None:
    c = text[0]
    if text.startswith("#!"):
        return "hashbang"
    if text.startswith(("//", "/*")) or c.isspace():
        return ""
    if '"' in text:
        return "STR" if text[-1] in '"#' and len(text) > 1 else None
    if c == "'" or text.startswith("b'"):
        if re.fullmatch(r"'[^\W\d]\w*", text):
            return "LIFETIME"
        return "NUM" if re.fullmatch(r"b?'(?:[^'\\\n]|\\(?:[nrt\\0'\"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,7}\}))'", text) else None
    if text == "_":
        return "_"
    if text in _RUST_WORDS:
        return text if text in RUST.sym else None
    if text in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="):
        return "ASSIGN"
    if text in ("/", "%", "^", "==", "!=", "<=", ">="):
        return "BINARY"
    if c.isdigit():
        return "NUM" if re.fullmatch(r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?|\d+\.", text) else None
    return _plain(text) if c != "$" else "$"


def rust_lexer() -> Lexer:
    comment = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/)*\*/"
    pattern = (
        rf"\#!(?!\[)[^\n]*|{_LINE}|{comment}|b?r\"[^\"]*\"|b?r\#\"(?:[^\"]|\"(?!\#))*\"\#|b?r\#\#\"(?:[^\"]|\"(?!\#\#))*\"\#\#|[bc]?\"(?:[^\"\\]|\\.)*\""
        r"|b?'(?:[^'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|.))'|'[^\W\d]\w*|r\#[^\W\d]\w*|[^\W\d]\w*"
        r"|\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d[\w]*)?|\d+\.(?![.\w])|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||<<=|>>=|[-+*/%&|^=!<>]=|\s+|."
    )
    return Lexer(RUST, pattern, _rust_token)


# ---- Python

PYTHON = Grammar(
    r"""
    file <- NEWLINE? stmt*
    stmt <- compound / simple ( ';' simple )* ';'? NEWLINE
    quick_ <- NAME ( '.' NAME )* ( ( '=' / AUG ) simple_ / '(' ( simple_ ( ',' simple_ )* )? ')' ) &NEWLINE / 'return' simple_ &NEWLINE
    simple <- quick_ / 'import' dotted ( ',' dotted )* / 'from' ( ( '.' / '...' )* name / ( '.' / '...' )+ ) 'import' ( '*' / '(' alias ( ',' alias )* ','? ')' / alias ( ',' alias )* )
       / 'pass' / 'break' / 'continue' / 'return' exprs? / 'raise' ( expr ( 'from' expr )? )? / ( 'global' / 'nonlocal' ) NAME ( ',' NAME )* / 'del' exprs / 'assert' expr ( ',' expr )?
       / 'type' NAME typeparams? '=' expr / assignment
    dotted <- name ( 'as' NAME )?
    name <- NAME ( '.' NAME )*
    alias <- NAME ( 'as' NAME )?
    assignment <- target_list ( AUG ( yield / exprs ) / ':' expr ( '=' ( yield / exprs ) )? / ( '=' ( yield / exprs ) )+ )? / yield
    target_list <- exprs
    yield <- 'yield' ( 'from' expr / exprs? )
    exprs <- starred ( ',' starred )* ','?
    starred <- '*' binary / named
    named <- NAME ':=' expr / expr
    compound <- decorated / if / while / for / try / with / def / class / match / 'async' ( def / for / with )
    decorated <- ( '@' named NEWLINE )+ ( 'async'? def / class )
    block <- ':' ( NEWLINE INDENT stmt+ DEDENT / simple ( ';' simple )* ';'? NEWLINE )
    if <- 'if' named block ( 'elif' named block )* ( 'else' block )?
    while <- 'while' named block ( 'else' block )?
    for <- 'for' targets 'in' exprs block ( 'else' block )?
    targets <- ( '*'? primary ) ( ',' '*'? primary )* ','?
    try <- 'try' block ( ( 'except' '*'? ( expr ( 'as' NAME / ( ',' expr )+ )? )? block )+ ( 'else' block )? ( 'finally' block )? / 'finally' block )
    with <- 'with' ( '(' item ( ',' item )* ','? ')' &':' / item ( ',' item )* ) block
    item <- expr ( 'as' ( '*'? primary ) )?
    def <- 'def' NAME typeparams? '(' params? ')' ( '->' expr )? block
    params <- param ( ',' param )* ','?
    param <- '/' / '**' NAME ( ':' expr )? / '*' ( NAME ( ':' '*'? expr )? )? / NAME ( ':' expr )? ( '=' expr )?
    class <- 'class' NAME typeparams? ( '(' args? ')' )? block
    typeparams <- '[' typeparam ( ',' typeparam )* ','? ']'
    typeparam <- ( '*' / '**' )? NAME ( ':' expr )? ( '=' expr )?
    match <- 'match' exprs ':' NEWLINE INDENT ( 'case' pattern ( ',' pattern )* ','? ( 'if' named )? block )+ DEDENT
    pattern <- orpattern ( 'as' NAME )?
    orpattern <- closed ( '|' closed )*
    closed <- '*' NAME / '(' ( pattern ( ',' pattern )* ','? )? ')' / '[' ( pattern ( ',' pattern )* ','? )? ']' / '{' ( keypattern ( ',' keypattern )* ','? )? '}'
       / name ( '(' ( ( NAME '=' )? pattern ( ',' ( NAME '=' )? pattern )* ','? )? ')' )? / literal
    keypattern <- '**' NAME / ( literal / name ) ':' pattern
    literal <- '-'? NUM ( ( '+' / '-' ) NUM )? / STR+ / CONST
    expr <- simple_ &stop_ / 'lambda' lambdaparams? ':' expr / binary ( 'if' binary 'else' expr )?
    operand_ <- NAME ( '.' NAME )* / NUM / STR+ / CONST / '...'
    sign_ <- 'not' / '-' / '+' / '~'
    simple_ <- sign_* operand_ ( operator sign_* operand_ )*
    stop_ <- ')' / ']' / '}' / ',' / ':' / ';' / '=' / NEWLINE
    lambdaparams <- lambdaparam ( ',' lambdaparam )* ','?
    lambdaparam <- '/' / '**' NAME / '*' NAME? / NAME ( '=' expr )?
    binary <- unary ( operator unary )*
    operator <- OP / '*' / '**' / '/' / '-' / '+' / '|' / '@' / 'and' / 'or' / 'in' / 'not' 'in' / 'is' 'not'?
    unary <- ( 'not' / '-' / '+' / '~' / 'await' )* primary
    primary <- atom ( '.' NAME / '(' args? ')' / '[' slices ']' )*
    args <- ( NAME '=' )? simple_ ( ',' ( NAME '=' )? simple_ )* ','? &')' / arg ( ',' arg )* ','?
    arg <- '**' expr / '*' expr / NAME '=' expr / named compfor?
    slices <- slice ( ',' slice )* ','?
    slice <- expr? ':' expr? ( ':' expr? )? / starred
    compfor <- ( 'async'? 'for' targets 'in' binaryif ( 'if' binaryif )* )+
    binaryif <- 'lambda' lambdaparams? ':' expr / binary
    atom <- NAME / NUM / STR+ / CONST / '...' / '(' ( yield / starred ( compfor / ( ',' starred )* ','? ) )? ')' / '[' simple_ ( ',' simple_ )* ','? ']' / '[' ( starred ( compfor / ( ',' starred )* ','? ) )? ']'
       / '{' ( dictitem ( compfor / ( ',' dictitem )* ','? ) )? '}' / '{' starred ( compfor / ( ',' starred )* ','? ) '}'
    dictitem <- '**' binary / expr ':' expr
    fexpr <- ( yield / exprs ) '='?
    """,
    "NAME NUM STR CONST OP AUG NEWLINE INDENT DEDENT",
    "match case type",
)
_PY_WORDS = set(
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_PREFIX = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
_PY_NUM = re.compile(
    r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*\.?[eE][+-]?\d(?:_?\d)*|\d(?:_?\d)*\.)[jJ]?"
)


class PythonLexer(Lexer):
    """Line ends outside brackets become NEWLINE with INDENT and DEDENT; expressions inside f-strings are parsed on their own."""

    _FIRST = 0xF000

    def __init__(self):
        comment = r"\#[^\n]*"
        pattern = (
            rf"\n(?:[ \t\f]*(?:{comment})?\r?\n)*[ \t\f]*(?:{comment}(?=\Z))?|\\\r?\n|{comment}|[ \t\f\r]+"
            rf'|{_PY_PREFIX}(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
            r"|[^\W\d]\w*|(?:\d|\.\d)(?:[eE][+-]|[\w.])*|\.\.\.|:=|->|\*\*=|//=|<<=|>>=|\*\*|//|<<|>>|[-+*/%&|^@=!<>]=|."
        )
        super().__init__(PYTHON, pattern, self._token)
        c = PYTHON.classes
        self.newline, self.indent, self.dedent = c["NEWLINE"], c["INDENT"], c["DEDENT"]
        self.virtual = self.newline + self.indent + self.dedent
        s = PYTHON.sym
        self.deeper, self.shallower = {s[x] for x in "([{"}, {s[x] for x in ")]}"}
        self.events = re.compile(f"[{re.escape(''.join(self.deeper | self.shallower))}\uf000-\uf7ff]")
        self.expression = None

    def __call__(self, source: str):
        return super().__call__("\n" + source)

    def offset(self, source: str, n: int) -> int:
        return max(0, super().offset("\n" + source, n) - 1)

    def finish(self, s: str):
        out, at, depth, levels = [], 0, 0, [0]
        began = False
        for m in self.events.finditer(s):
            c, i = m.group(), m.start()
            if c in self.deeper:
                depth += 1
            elif c in self.shallower:
                depth = max(0, depth - 1)
            else:
                out.append(s[at:i])
                began = began or i > 0
                at = i + 1
                if depth or at == len(s):
                    continue
                width = ord(c) - self._FIRST
                if began:
                    out.append(self.newline)
                if width > levels[-1]:
                    levels.append(width)
                    out.append(self.indent)
                while width < levels[-1]:
                    levels.pop()
                    out.append(self.dedent)
                if width != levels[-1]:
                    out.append(ERROR)
        out.append(s[at:])
        out.append(self.newline * (s[:1] != "" and len("".join(out)) > 0) + self.dedent * (len(levels) - 1))
        return "".join(out), frozenset()

    def _token(self, text: str) -> str | None:
        c = text[0]
        if c == "\n":
            tail = text[text.rfind("\n") + 1 :].split("#")[0].replace("\f", "")
            return chr(self._FIRST + min(len(tail.expandtabs(8)), 0x7FF))
        if c in "#\\ \t\r\f":
            return "" if c != "\\" or len(text) > 1 else None
        if c in "\"'" or (text[-1] in "\"'" and c.isalpha()):
            if len(text) < 2:
                return None
            head = text[: min(text.find('"') % (len(text) + 1), text.find("'") % (len(text) + 1))].lower()
            return "STR" if "f" not in head or self._fields(text) else None
        if text in ("True", "False", "None", "..."):
            return "CONST" if text != "..." or "..." not in PYTHON.sym else "..."
        if text in _PY_WORDS:
            return text if text in PYTHON.sym else None
        if text in ("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="):
            return "AUG"
        if text in ("//", "%", "<<", ">>", "&", "^", "==", "!=", "<", ">", "<=", ">="):
            return "OP"
        if c.isdigit() or (c == "." and len(text) > 1):
            return "NUM" if _PY_NUM.fullmatch(text) else None
        return "NAME" if c.isalpha() or c == "_" else None

    def _fields(self, text: str) -> bool:
        quote = 3 if text.endswith(('"""', "'''")) and len(text) > 5 else 1
        body = text[text.index(text[-1]) + quote : -quote]
        at = 0
        while m := re.compile(r"\{\{|\}\}|[{}]").search(body, at):
            if m.group() in ("{{", "}}"):
                at = m.end()
                continue
            end = self._field_end(body, m.end()) if m.group() == "{" else -1
            if end < 0:
                return False
            if self.expression is None:
                self.expression = PYTHON.parser(start="fexpr")
            if self.expression(super().__call__(body[m.end() : end].replace("\n", " "))[0].rstrip(self.newline)) != -1:
                return False
            depth, at = 1, end
            while depth and at < len(body):  # over the conversion and the format, which may hold fields again
                depth += (body[at] == "{") - (body[at] == "}")
                at += 1
            if depth:
                return False
        return True

    @staticmethod
    def _field_end(body: str, start: int) -> int:
        """Where the expression of a replacement field ends."""
        depth = 0
        for m in re.compile(r"\"[^\"]*\"|'[^']*'|[\[({})\]]|!(?!=)|:").finditer(body, start):
            if depth == 0 and m.group() in "}:!":
                return m.start()
            depth += 1 if m.group() in "([{" else -1 if m.group() in ")]}" else 0
        return -1


# ---- Shell

SHELL = Grammar(
    r"""
    file <- NL* list? EOF
    EOF <- !ANY
    list <- andor ( sep andor )* sep?
    sep <- ( ';' / '&' / NL ) NL*
    andor <- pipeline ( ( '&&' / '||' ) NL* pipeline )*
    pipeline <- ( '!' / 'time' )* command ( ( '|' / '|&' ) NL* command )*
    command <- function / compound redirect* / simple
    redirect <- REDIR any / HEREDOC
    any <- WORD / NAME / ASSIGN / keyword
    keyword <- 'if' / 'then' / 'else' / 'elif' / 'fi' / 'do' / 'done' / 'case' / 'esac' / 'while' / 'until' / 'for' / 'select' / 'in' / 'function' / 'time' / '{' / '}' / '!' / '[[' / ']]' / 'coproc'
    simple <- ( ASSIGN / array / redirect )* ( WORD / NAME / 'in' / ']]' ) ( any / array / redirect )* / ( ASSIGN / array / redirect )+
    array <- ARRAY ( any / NL )* ')'
    compound <- '{' NL* list '}' / '(' NL* list ')' / if / loop / for / case / '[[' ( !']]' ANY )* ']]' / ARITH
    function <- ( WORD / NAME ) '(' ')' NL* compound redirect* / 'function' ( WORD / NAME ) ( '(' ')' )? NL* compound redirect*
    then <- NL* list
    if <- 'if' then 'then' then ( 'elif' then 'then' then )* ( 'else' then )? 'fi'
    loop <- ( 'while' / 'until' ) then do
    do <- 'do' then 'done'
    for <- 'for' ARITH ';'? NL* do / ( 'for' / 'select' ) NAME ( NL* 'in' any* )? sep? do
    case <- 'case' any NL* 'in' NL* ( branch ( ';;' / ';&' / ';;&' ) NL* )* branch? 'esac'
    branch <- !'esac' '('? any ( '|' any )* ')' NL* list?
    """,
    "NL WORD NAME ASSIGN ARRAY REDIR HEREDOC ARITH",
)


class ShellLexer(Lexer):
    """Quoting and substitutions are matched by a recursive pattern; commands inside $( ) are parsed on their own."""

    def __init__(self):
        import regex

        super().__init__(SHELL, "", self._token)
        define = r"""(?(DEFINE)
            (?<sq>'[^']*+')
            (?<dq>"(?:[^"\\$`]|\\.|(?&sub)|\$|`[^`]*+`)*+")
            (?<sub>\$\((?&inn)\)|\$\{(?&brc)\})
            (?<inn>(?:[^()'"\\`$]|\\.|(?&sq)|(?&dq)|(?&sub)|\$|`[^`]*+`|\((?&inn)\))*+)
            (?<brc>(?:[^{}'"\\`$]|\\.|(?&sq)|(?&dq)|(?&sub)|\$|'|`[^`]*+`|\{(?&brc)\})*+)
            (?<easy>(?:[^\s|&;()<>"'`$\\\#]|(?<=[^\s|&;()<>])\#|'[^']*+'|"[^"\\`$]*+(?:\$\w+[^"\\`$]*+|\$\{\w+\}[^"\\`$]*+)*+"|\$\w+|\$\{\w+\})++(?=[\s|&;)<>]|\Z))
            (?<word>(?:[^\s|&;()<>"'`$\\]|\\.|(?&sq)|(?&dq)|(?&sub)|\$(?!\()|`[^`]*+`|[<>]\((?&inn)\))++)
        )"""
        pieces = (
            r"\#[^\n]*|\\\n|[ \t\r\f]+|\n"
            r"|<<-?[ \t]*(?:'(?<h>[^'\n]+)'|\"(?<h>[^\"\n]+)\"|\\?(?<h>\w+))[^\n]*(?:\n.*?)??(?:\n[\t]*(?P=h)(?=\n|\Z)|\Z)"
            r"|\(\((?&inn)\)\)|[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=(?:\(|(?&word)?)|\d*(?:<<<|&>>|&>|>>|>\||<>|>&|<&|>(?!\()|<(?!\())|;;&|;;|;&|&&|\|\||\|&|[;&|()]|(?&easy)|(?&word)|."
        )
        self.pattern = regex.compile(define + f"(?:{pieces})", regex.S | regex.V0)
        self.inner = None

    def __call__(self, source: str):
        get, symbol = self.known.get, self.symbol
        pieces = [m.group() for m in self.pattern.finditer(source)]
        return "".join([s if (s := get(t)) is not None else symbol(t) for t in pieces]), frozenset()

    def _token(self, text: str) -> str | None:
        c = text[0]
        if c == "\n":
            return "NL"
        if c in "# \t\r\f" or text == "\\\n":
            return ""
        if text.startswith("<<") and not text.startswith("<<<"):
            return "HEREDOC NL" if "\n" in text else "HEREDOC"
        if text.startswith("(("):
            return "ARITH"
        if re.fullmatch(r"\d*(?:<<<|&>>|&>|>>|>\||<>|>&|<&|>|<)", text):
            return "REDIR"
        if text in "\"'`()|&;$" or not self._commands(text):
            return None
        m = re.match(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=", text)
        if m:
            return "ARRAY" if text[m.end() :] == "(" else "ASSIGN"
        return "NAME" if re.fullmatch(r"[A-Za-z_]\w*", text) else "WORD"

    def _commands(self, text: str) -> bool:
        """Whether all commands of a word's substitutions are valid."""
        at = 0
        while (at := text.find("$(", at)) >= 0:
            if text.startswith("$((", at):
                at += 3
                continue
            quoted = text[:at].count("'") % 2 and '"' not in text[:at]
            m = None if quoted or (at and text[at - 1] == "\\") else self._whole(text, at)
            if m:
                if self.inner is None:
                    self.inner = SHELL.parser()
                if self.inner(*self(m[2:-1])) != -1:
                    return False
                at += len(m)
            else:
                at += 2
        return True

    def _whole(self, text: str, at: int) -> str | None:
        depth = 0
        for m in re.finditer(r"\\.|'[^']*'|[()]", text[at:], re.S):
            depth += {"(": 1, ")": -1}.get(m.group(), 0)
            if m.group() == ")" and not depth:
                return text[at : at + m.end()]
        return None


GRAMMARS = {
    "json": (JSON, json_lexer),
    "javascript": (JS, lambda: JsLexer(JS)),
    "typescript": (TS, lambda: JsLexer(TS)),
    "go": (GO, GoLexer),
    "java": (JAVA, java_lexer),
    "rust": (RUST, rust_lexer),
    "python": (PYTHON, PythonLexer),
    "shell": (SHELL, ShellLexer),
}
