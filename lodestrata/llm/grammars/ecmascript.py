"""JavaScript and TypeScript."""

from lodestrata.llm.peg import Grammar

#: Reserved words of the language, in the order of its specification.
RESERVED = (
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with"
)
SPACE = r"(?:\s++|//[^\n]*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+"
_KW = "|".join(w for w in RESERVED.split() if w != "await")

COMMON = r"""
file = `#![^\n]*`? statement* !`[\s\S]`
ident = `(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+|\$[\w$]*+|\#[\w$]++`
word = `[^\W\d][\w$]*+|\$[\w$]*+|\#[\w$]++`
end = `;` / &`\}` / !`[\s\S]` / `(?<=[\n\r][ \t]*)`
string = `"(?>[^"\\\n]+|\\[\s\S])*+"|'(?>[^'\\\n]+|\\[\s\S])*+'`
number = `(?:0[xX][\da-fA-F_]++|0[bB][01_]++|0[oO]?[0-7_]++(?![\d.eE])|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)n?(?![\w$])`
regexp = `/(?![*/])(?>[^\\/\[\n]+|\\.|\[(?>[^\]\\\n]+|\\.)*+\])++/[a-z]*+`
template = ~'`' TPLCHUNK* '`'
literal = string / number / template / regexp
block = '{' statement* '}'
expr = assign (',' assign)*
binop = `(?:>>>=?|\*\*=?|<<=?|>>=?|&&=?|\|\|=?|\?\?=?|===?|!==?|<=|>=|[-+*/%&|^]=|=(?!>)|[-+*/%&|^<>])` / "in" / "instanceof"
assign = arrow / yieldx / unary (binop (arrow / unary) / '?' assign ':' assign)*
yieldx = "yield" (`\*`? assign)?
prefix = `\+\+|--|[-+!~](?!=)` / "typeof" / "void" / "delete" / "await"
unary = prefix* postfix
postfix = (qcall / primary) suffix* `\+\+|--`? CAST*
suffix = `\?\.`? '(' args? ')' / `\?\.`? '[' expr ']' / `\??\.(?!\d)` word / template TSSUFFIX
args = arg (',' arg)* `,`?
arg = `\.\.\.`? assign
primary = literal / function / class / newx / ident / "this" / "super" / "null" / "true" / "false" / '(' expr ')' / array / object / "import" (`\.` word / '(' args ')') JSXPRIM
newx = "new" (`\.` word / newx / (class / function / ident / "this" / '(' expr ')') (`\.` word / '[' expr ']')* TARGS? ('(' args? ')')?)
array = '[' (literal (',' literal)* `,`?)? ']' / '[' (`,` / arg)* ']'
object = qobject / '{' (prop (',' prop)* `,`?)? '}'
prop = `\.\.\.` assign / accessor / modasync propname TPARAMS? params RET block / propname ':' assign / ident (`=(?![=>])` assign)?
accessor = `(?:get|set)(?![\w$])(?!\s*[(:,}=])` propname params RET block
modasync = (`async(?![\w$])(?!\s*[(:,}=])`)? `\*`?
propname = word / string / number / '[' assign ']'
function = (`async(?![\w$])`)? "function" `\*`? ident? TPARAMS? params RET (block)
params = qparams / '(' (param (',' param)* `,`?)? ')'
param = DECO* PMOD `\.\.\.`? pattern OPTMARK ANNOT (`=(?![=>])` assign)?
pattern = ident / "this" / '{' (patprop (',' patprop)* `,`?)? '}' / '[' (`,` / `\.\.\.`? pattern (`=(?![=>])` assign)?)* ']'
patprop = `\.\.\.` pattern / propname ':' pattern (`=(?![=>])` assign)? / ident (`=(?![=>])` assign)?
arrow = &`(?:async(?![\w$])\s*)?(?:[<(]|[\w$]+\s*=>)` (`async(?![\w$])(?!\s*=>)`)? (ident `=>` / TPARAMS? params RET `=>`) (block / assign)
qmember = `get(?=\s+[\w$])` word '(' ')' RET '{' "return" qexpr `;` '}'
class = DECO* ABSTRACT "class" (!"extends" !"implements" ident)? TPARAMS? ("extends" postfix TARGS?)? IMPL '{' member* '}'
member = `;` / qmember / "static" block / DECO* MMOD (`(?:get|set)(?![\w$])(?!\s*[(:;=}?!])` propname params RET (block / end) / modasync propname OPTMARK TPARAMS? params RET (block MEMBEREND) / INDEXSIG propname OPTMARK ANNOT (`=(?![=>])` assign)? end)
# The most common statements, without nesting: one pattern each.
qname = `(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+(?:\??\.[^\W\d][\w$]*+)*+(?![\w$])` / `this(?:\.[\w$]++)*+(?![\w$])` / `true|false|null(?![\w$])`
qatom = string / number / qname / '[' ']' / '{' '}' / `\x60[^\x60\\$]*+(?:\$\{[\w.]++\}[^\x60\\$]*+)*+\x60`
qarrow = '(' `[\w$]++` ')' `=>` `[\w$.]++` (binop `[\w$.]++|"[^"\\\n]*+"`)?
qargs = '(' ((qarrow / qatom) `,|(?=\))`)* ')'
qcall = ("new" / "void")? qatom (qargs / '[' qatom ']' / `\.` word)*
qterm = `!`? qcall (binop `!`? qcall)*
qlist = '[' (qatom `,|(?=\])`)* ']'
qexpr = qlist / qterm (`\?(?![.?])` qcall ':' qcall)?
qfunc = "function" `[\w$]*+` '(' (`[\w$]++` `,|(?=\))`)* ')' '{' ("return"? qexpr `;`?)? '}'
qobject = '{' (word ':' qterm `,|(?=\})`)+ '}'
qparam = ident QTYPE (`=(?![=>])` qatom)? &`[,)]`
qparams = '(' (qparam (',' qparam)*)? ')'
quick = ("return" / "throw" / ("const" / "let" / "var") ident QTYPE '=' / !`(?:function|class|async|import|export|interface|type|declare|namespace|module|abstract|enum|let)(?![\w$])`) (qobject / qfunc !`[(.\[]` / qexpr (',' `[\w$]++` '=' qexpr)*) (`;` / &`\}`) / `!` qfunc qargs (`;` / &`\}`) / &`function\s+[\w$]` qfunc
parens = '(' qexpr ')' / '(' expr ')'
statement = quick / !`[})]` other
other = `;` / block / vardecl end / (`async(?![\w$])`)? &"function" function / "async" function / &`@|(?:class|abstract)(?![\w$])` class / ifs / fors / "while" parens statement / "do" statement "while" '(' expr ')' `;`? / returns / "throw" expr end / trys / switch / "break" ident? end / "continue" ident? end / "debugger" end / &"import" import / &`@|export(?![\w$])` export / TSSTATEMENT ident ':' statement / !`\{` !"function" !"class" expr end
vardecl = CONSTDECL ("const" / "let" / "var") declarator (',' declarator)*
declarator = pattern `!`? ANNOT (`=(?![=>])` assign)?
ifs = "if" parens statement ("else" statement)?
fors = "for" "await"? '(' (forhead / (vardecl / expr)? `;` expr? `;` expr?) ')' statement
forhead = (("const" / "let" / "var") pattern ANNOT / postfix) ("of" assign / "in" expr)
returns = "return" (!`(?<=\n[ \t]*)` expr)? end
trys = "try" block ("catch" ('(' pattern ANNOT ')')? block)? ("finally" block)?
switch = "switch" '(' expr ')' '{' (("case" expr / "default") ':' statement*)* '}'
import = "import" !`[.(]` (string / TYPEONLY importclause "from" string) ("with" object)? end
importclause = '*' "as" ident / names / ident (',' ('*' "as" ident / names))?
names = '{' (TYPEONLY (word / string) ("as" (word / string))? (',' TYPEONLY (word / string) ("as" (word / string))?)* `,`?)? '}'
export = DECO* "export" ("default" (&`(?:async\s+)?function(?![\w$])` function / class / TSDEFAULT assign end) / '*' ("as" (word / string))? "from" string end / TYPEONLY names ("from" string)? end / !block statement)
"""



TYPES = r"""
tparams = '<' tparam (',' tparam)* `,`? '>'
tparam = "const"? ident ("extends" type)? ('=' type)?
targs = '<' type (',' type)* '>'
rettype = "asserts" ident ("is" type)? / (ident / "this") "is" type / type
type = ("abstract"? "new")? tparams? params '=>' rettype / union ("extends" union `\?` type ':' type)?
union = `[|&]`? typeop (`[|&](?![|&])` typeop)*
typeop = ("keyof" / "readonly" / "unique" / "infer" / "typeof") typeop / typeprim ('[' type? ']')*
typeprim = '(' type ')' / '[' (tupleitem (',' tupleitem)* `,`?)? ']' / objtype / string / `-`? number / template / "import" '(' string ')' (`\.` word)* targs? / word (`\.` word)* targs?
tupleitem = `\.\.\.`? (word `\??` ':' type / type `\??`)
objtype = '{' (typemember `[;,]?`)* '}'
typemember = (`(?:readonly|[-+]readonly)(?![\w$])(?!\s*[(:;,?}])`)? ('[' ident ("in" type ("as" type)? / ':' type) ']' `[-+]?\??` ':' type / `(?:get|set)(?![\w$])(?!\s*[(:;,?}])` propname params (':' rettype)? / propname `\??` (tparams? params (':' rettype)? / (':' type)?) / "new"? tparams? params (':' rettype)?)
interface = "interface" ident tparams? ("extends" type (',' type)*)? objtype
tsdecl = interface / "type" ident tparams? '=' type end / "const"? "enum" ident '{' (propname ('=' assign)? (',' propname ('=' assign)?)* `,`?)? '}' / ("namespace" / "module") (string / ident (`\.` ident)*) block / "declare" (("global" block) / tsdecl / statement) / "import" ident '=' expr end / "export" ('=' expr end / "as" "namespace" ident end)
"""
#: Elements in place of expressions. White space and comments are skipped within tags only.
JSX = r"""
jsx = element ws
element = ~`<(?=[A-Za-z_$>])` (~`>` child* ~`</\s*>` / tagname TARGS? attribute* (~`/\s*>` / ~`>` child* ~`</\s*` tagname ~`>`))
tagname = `[A-Za-z_$][\w$-]*+(?:[.:][A-Za-z_$][\w$-]*+)*+`
attribute = '{' `\.\.\.` assign '}' / tagname ('=' (`"[^"]*+"|'[^']*+'` / '{' assign '}' / jsx))?
child = ~`[^<>{}]++` / ~`\{` ws (`\.\.\.`? expr)? ~`\}` / element
"""
DECORATOR = "\ndecorator = `@` postfix\n"

#: Where the two languages differ.
SLOTS = {
    "CAST": ('`(?!)`', '("as" type / "satisfies" type / `!(?![=])`)'),
    "TSSUFFIX": ("", "/ targs &`[(\\x60]`"),
    "TARGS": ("`(?!)`", "targs"),
    "TPARAMS": ("`(?!)`", "tparams"),
    "ANNOT": ("", "(':' type)?"),
    "RET": ("", "(':' rettype)?"),
    "QTYPE": ("", "(':' (`[A-Za-z]+(?:<[A-Za-z, ]*>)?(?:\\[\\])?(?![\\w$<\\[|&.])`))?"),
    "DECO": ("decorator", "decorator"),
    "PMOD": ("", "(`(?:public|private|protected|readonly|override)(?![\\w$])(?!\\s*[,:)=?])`)*"),
    "OPTMARK": ("", "`[?!]?`"),
    "ABSTRACT": ("", '"abstract"?'),
    "IMPL": ("", '("implements" type (\',\' type)*)?'),
    "MMOD": ("(`static(?![\\w$])(?!\\s*[(=;}])`)?", "(`(?:public|private|protected|static|readonly|abstract|override|declare|accessor)(?![\\w$])(?!\\s*[(:;=?!}])`)*"),
    "MEMBEREND": ("", "/ end"),
    "INDEXSIG": ("", "'[' ident ':' type ']' ':' type end /"),
    "TSSTATEMENT": ("", "&`(?:interface|type|const|enum|namespace|module|declare|import|export)(?![\\w$])` tsdecl /"),
    "TYPEONLY": ("", '("type" !"from" !`[,=]`)?'),
    "TSDEFAULT": ("", "interface /"),
    # A constant needs its value; only an ambient declaration, which TypeScript alone has, does without.
    "CONSTDECL": ("\"const\" valued (',' valued)* / !\"const\"", ""),
}


def _fill(text: str, which: int, elements: bool = False) -> str:
    text = text.replace("JSXPRIM", "/ jsx" if elements else "")
    for name, choice in SLOTS.items():
        text = text.replace(name, choice[which])
    text = text.replace("TPLCHUNK", "(~`(?>[^\\x60\\\\$]+|\\\\[\\s\\S]|\\$(?!\\{))+` / ~`\\$\\{` ws expr ~`\\}`)")
    return text.replace("KW", _KW) + "\nws = ~`" + SPACE + "`\n"


VALUED = "\nvalued = pattern `=(?![=>])` assign\n"


def javascript() -> Grammar:
    return Grammar(_fill(COMMON + VALUED + DECORATOR, 0), SPACE)


def jsx() -> Grammar:
    return Grammar(_fill(COMMON + VALUED + DECORATOR + JSX, 0, True), SPACE)


def typescript() -> Grammar:
    return Grammar(_fill(_overloads() + DECORATOR + TYPES, 1), SPACE)


def tsx() -> Grammar:
    return Grammar(_fill(_overloads() + DECORATOR + TYPES + JSX, 1, True), SPACE)


def _overloads() -> str:
    return COMMON.replace("params RET (block)", "params RET (block / end)")
