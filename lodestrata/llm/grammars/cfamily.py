"""C, Java, C#, Rust, Go and PHP."""

import re

from lodestrata.llm.peg import Grammar

SLASH = r"(?:\s++|//[^\n]*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+"

# ------------------------------------------------------------------ C
C_SPACE = r"(?:\s++|//(?>[^\\\n]+|\\[\s\S])*+|/\*(?>[^*]+|\*(?!/))*+\*/|(?<![^\n])[ \t]*+\#(?>[^\\\n/]+|\\[\s\S]|/(?!\*)|/\*(?>[^*]+|\*(?!/))*+\*/)*+|\\\n)*+"
#: Keywords of the language.
C_KW = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Atomic _Bool _Complex _Generic _Noreturn _Static_assert _Thread_local"
C = r"""
file = (external)* !`[\s\S]`
ident = `(?!(?:KW)\b)[^\W\d]\w*+`
string = (`(?:u8|[LuU])?"(?>[^"\\\n]+|\\[\s\S])*+"`)+
char = `[LuU]?'(?>[^'\\\n]+|\\[\s\S])++'`
number = `(?:0[xX][\da-fA-F.]++(?:[pP][+-]?\d++)?|0[bB][01]++|(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?)[uUlLfF]*+(?![\w.])`
literal = number / string / char
external = `;` / typedef / function / declaration / "_Static_assert" '(' expr ')' `;` / asm `;` / ident '(' args? ')' `;` / `[A-Z][A-Z0-9_]*+\((?>[^()\n"]++|"[^"\n]*+")*+\)(?=[ \t\r]*+(?:\n|\Z))`
asm = `(?:asm|__asm__|__asm)\b` `(?:volatile|__volatile__|__volatile|goto|inline)\b`* '(' balanced* ')'
typedef = "typedef" specs declarator (',' declarator)* attr* `;`
function = specs declarator attr* block
declaration = specs (initdecl (',' initdecl)*)? `;`
initdecl = declarator attr* ('=' init)?
init = '{' (initlist)? '}' / assign
initlist = (literal (',' literal)* `,`? &`\}`) / inititem (',' inititem)* `,`?
inititem = ((`\.` ident / '[' expr (`\.\.\.` expr)? ']')+ '=')? init
attr = ("__attribute__" / "__declspec") '(' balanced* ')' / ("asm" / "__asm__") '(' balanced* ')'
balanced = string / '(' balanced* ')' / `[^()\s"]++`
qualifier = `(?:const|volatile|restrict|static|extern|inline|register|auto|_Atomic|_Noreturn|_Thread_local|__inline|__inline__|__restrict|__extension__)\b` / attr
builtin = `(?:void|char|short|int|long|float|double|signed|unsigned|_Bool|_Complex)\b`
specs = qualifier* (builtin (builtin / qualifier)* / aggregate qualifier* / ident qualifier* / &`[A-Za-z_*]`)
aggregate = ("struct" / "union") attr* (ident? '{' (member)* '}' / ident) attr* / "enum" attr* (ident? '{' enumerator (',' enumerator)* `,`? '}' / ident)
enumerator = ident ('=' cond)?
member = `;` / specs (memberdecl (',' memberdecl)*)? attr* `;`
memberdecl = declarator (':' cond)? / ':' cond
pointer = `\*` qualifier*
declarator = pointer* attr* (ident / '(' declarator ')') dsuffix*
dsuffix = '[' (qualifier* assign?) ']' / params
params = qparams / '(' ("void" &`\)` / (param (',' param)* (',' `\.\.\.`)?)?) ')'
qparams = '(' (`(?:const\s+)?(?:unsigned\s+|struct\s+)?[A-Za-z_]\w*+[\s*]+(?!(?:KW)\b)[A-Za-z_]\w*+` (',' `(?:const\s+)?(?:unsigned\s+|struct\s+)?[A-Za-z_]\w*+[\s*]+(?!(?:KW)\b)[A-Za-z_]\w*+`)*)? ')'
param = specs (declarator / abstract)? attr*
abstract = pointer+ (adirect)* / adirect+
adirect = '(' abstract ')' / '[' assign? ']' / '(' (param (',' param)*)? ')'
typename = specs abstract?
block = '{' statement* '}'
qname = `(?!(?:KW)\b)[^\W\d]\w*+(?:(?:\.|->)[^\W\d]\w*+)*+`
qatom = literal / qname
qargs = '(' (qatom (',' qatom)*)? ')'
qunary = `[*&!~-]?` qatom (qargs / '[' qatom ']')? `\+\+|--`?
qexpr = qunary (binop qunary)*
quick = ("return" qexpr? / "goto" ident / (`(?:const\s+)?(?:unsigned\s+|struct\s+)?(?!(?:return|goto|else|case|sizeof|typedef|break|continue|do)\b)[A-Za-z_]\w*+\s*[\s*]\s*` ident '=')? qexpr) `;`
parens = '(' qexpr ')' / '(' expr ')'
statement = quick / !`[})]` other
other = `;` / block / asm `;` / "if" parens statement ("else" statement)? / "while" parens statement / "for" '(' (`(?:int|size_t|long|unsigned)\s` qname '=' qatom `;` qexpr `;` qunary ')' / (declaration / expr? `;`) expr? `;` expr? ')') statement / "do" statement "while" '(' expr ')' `;` / "switch" parens statement / "return" expr? `;` / "break" `;` / "continue" `;` / "goto" ident `;` / "case" cond (`\.\.\.` cond)? ':' / "default" ':' / ident ':' !':' / typedef / declaration / expr `;`
expr = assign (',' assign)*
binop = `<<=?|>>=?|&&|\|\||[<>=!+*/%&|^-]=|[+*/%&|^<>=-]`
assign = unary (binop unary / `\?` expr? ':' assign)*
cond = assign
cast = '(' typename ')' (unary / '{' initlist? '}')
unary = "sizeof" (unary / '(' typename ')') / "_Alignof" '(' typename ')' / `\+\+|--|[-+!~*&]|&&` unary / postfix !`[\w"'{]` / cast / postfix
postfix = (literal / ident / '(' expr ')' / '(' block ')' / "_Generic" '(' balanced* ')') (('[' expr ']') / '(' args? ')' / `\.|->` ident / `\+\+|--`)*
args = argument (',' argument)*
argument = assign / typename
"""

# ------------------------------------------------------------------ Java
JAVA_KW = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
JAVA = r"""
file = (annotation* "package" name `;`)? ("import" "static"? name (`\.` `\*`)? `;` / `;`)* (typedecl / `;`)* !`[\s\S]`
ident = `(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+`
name = `(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+(?:\s*\.\s*(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+)*+`
string = `\"\"\"[\s\S]*?\"\"\"|"(?>[^"\\\n]+|\\.)*+"`
char = `'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'`
number = `(?:0[xX][\da-fA-F_.]++(?:[pP][+-]?\d++)?|0[bB][01_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)[lLfFdD]?(?![\w])`
literal = string / number / char / `(?:true|false|null)(?![\w$])`
annotation = `@(?!interface\b)` name ('(' (annarg (',' annarg)* `,`?)? ')')?
annarg = (ident '=')? annvalue
annvalue = annotation / '{' (annvalue (',' annvalue)* `,`?)? '}' / ternary
modifier = annotation / `(?:public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default(?!\s*(?::|->))|sealed(?=\s+[\w@])|non-sealed)(?![\w$-])`
typedecl = modifier* (class / interface / enum / record / annotationtype)
class = "class" ident tparams? ("extends" type)? ("implements" types)? ("permits" types)? classbody
interface = "interface" ident tparams? ("extends" types)? ("permits" types)? classbody
record = "record" ident tparams? params ("implements" types)? classbody
annotationtype = `@\s*interface(?![\w$])` ident classbody
enum = "enum" ident ("implements" types)? '{' (constant (',' constant)*)? `,`? (`;` member*)? '}'
constant = annotation* ident ('(' args? ')')? classbody?
classbody = '{' member* '}'
member = `;` / "static" block / qmethod block / block / modifier* (class / interface / enum / record / annotationtype / method / field)
qmethod = (`(?:public|private|protected|static|final)(?![\w$])`)* `(?:[A-Z]\w*+(?:<[\w, ]*+>)?|int|long|boolean|void|double)(?:\[\])?(?=\s)` ident qparams
qparams = '(' (qtype ident (',' qtype ident)*)? ')'
qtype = `(?:[A-Z]\w*+(?:<[\w, ]*+>)?|int|long|boolean|double|char|byte|short|float)(?:\[\])?(?=\s)`
method = tparams? (("void" / type) ident params dims throws (block / ("default" annvalue)? `;`) / ident (params throws)? block)
throws = ("throws" types)?
field = type declarator (',' declarator)* `;`
declarator = ident dims ('=' init)?
init = '{' ((literal (',' literal)* `,`?  &`\}`) / (init (',' init)* `,`?))? '}' / expr
params = '(' (param (',' param)*)? ')'
param = modifier* type (annotation* `\.\.\.`)? ("this" / ident (`\.` "this")? dims)
dims = ('[' ']')*
primitive = `(?:boolean|byte|char|short|int|long|float|double)(?![\w$])`
type = annotation* (primitive / ident targs? (`\.` annotation* ident targs?)*) (annotation* '[' ']')*
types = type (',' type)*
targs = '<' (targ (',' targ)*)? '>'
targ = annotation* `\?` (("extends" / "super") type)? / type (`&` type)*
tparams = '<' annotation* ident ("extends" type (`&` type)*)? (',' annotation* ident ("extends" type (`&` type)*)?)* '>'
block = '{' statement* '}'
qname = `(?:this\.)?(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+(?:\.(?!(?:KW)(?![\w$]))[^\W\d][\w$]*+)*+` / `this(?![\w$.])`
qatom = literal / qname
qargs = '(' (qcall (',' qcall)*)? ')'
qcall = ("new" !`[a-z]`)? qatom ('(' (qatom (',' qatom)*)? ')')? (`\.` ident '(' (qatom (',' qatom)*)? ')')*
qexpr = `!`? qatom qargs? (`\.` ident qargs)* (binop `!`? qatom qargs?)*
quick = ("return" / ("throw" "new") / (qtype ident '=') / qname '=')? qexpr `;`
parens = '(' qexpr ')' / '(' expr ')'
localdecl = modifier* ("var" &`[A-Za-z_$]` declarator / type declarator (',' declarator)*)
statement = quick / !`[})]` other
other = `;` / block / "if" parens statement ("else" statement)? / "for" '(' (qtype ident ':' qexpr &`\)` / modifier* type ident ':' expr / (localdecl / exprs)? `;` expr? `;` exprs?) ')' statement / "while" parens statement / "do" statement "while" parens `;` / "return" expr? `;` / "throw" expr `;` / trys / switch / "break" ident? `;` / "continue" ident? `;` / "yield" !`[=.(\[+-]` expr `;` / "synchronized" '(' expr ')' block / "assert" expr (':' expr)? `;` / typedecl / ident ':' statement / localdecl `;` / expr `;`
trys = "try" ('(' resource (`;` resource)* `;`? ')')? block ("catch" '(' modifier* type (`\|` type)* ident ')' block)* ("finally" block)?
resource = localdecl / expr
switch = "switch" '(' expr ')' '{' (caselabel ('->' (block / "throw" expr `;` / expr `;`) / ':' statement*))* '}'
caselabel = "case" casevalue (',' casevalue)* ("when" expr)? / "default"
casevalue = "default" / modifier* type (ident &`\s*(?:->|:|,|when|&&)` / '(' balancedpattern* ')' ident?) / ternary
balancedpattern = '(' balancedpattern* ')' / `[^()\s]++`
exprs = expr (',' expr)*
binop = `>>>=|>>=|<<=|>>>|<<|>>|&&|\|\||[<>=!+*/%&|^-]=|->(?!)|[+*/%&|^<>=]|-(?!>)`
expr = lambda / unary (binop (lambda / unary) / `\?` expr ':' (lambda / expr) / "instanceof" "final"? type ('(' balancedpattern* ')')? ident?)*
ternary = expr
lambda = (ident / '(' (ident (',' ident)*)? ')' / params) '->' (block / expr)
cast = '(' (primitive ('[' ']')* ')' unary / type (`&` type)* ')' (lambda / !`[-+]` unary))
unary = `\+\+|--|[-+!~]` unary / cast / postfix
postfix = primary suffix* `\+\+|--`?
primary = literal / "new" creator / switch / "this" ('(' args? ')')? / "super" &`[.(:]` ('(' args? ')')? / (primitive / "void") dims (`\.` "class" / '::' (ident / "new")) / ident targs? ('[' ']')+ ('::' "new" / `\.` "class") / ident targs '::' (ident / "new") / ident ('(' args? ')')? / '(' expr ')'
creator = annotation* (primitive / ident (targs)? (`\.` ident targs?)*) (('[' expr ']')+ dims / ('[' ']')+ init / '(' args? ')' classbody?)
suffix = `\.(?!\.)` (targs? ident ('(' args? ')')? / "new" creator / "this" / "class" / "super" ('(' args? ')')?) / '[' expr ']' / '::' targs? (ident / "new")
args = expr (',' expr)*
"""


def c() -> Grammar:
    return Grammar(C.replace("KW", "|".join(C_KW.split())), C_SPACE, boundary=r"\w")


def java() -> Grammar:
    return Grammar(JAVA.replace("KW", "|".join(JAVA_KW.split())), SLASH)

# ------------------------------------------------------------------ C#
CSHARP_KW = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
CSHARP_SPACE = r"(?:\s++|//[^\n]*+|/\*(?>[^*]+|\*(?!/))*+\*/|(?<![^\n])[ \t]*+\#[^\n]*+)*+"
CSHARP = r"""
file = (`extern` "alias" ident `;`)* using* (`\[` ("assembly" / "module") ':' attrargs ']')* (filens / nsmember / statement)* !`[\s\S]`
filens = "namespace" name `;` (using / nsmember)*
using = "global"? "using" !`\(` !`var(?!\w)` ("static"? "unsafe"? (ident '=')? type) `;`
nsmember = "namespace" name '{' using* nsmember* '}' `;`? / typedecl
ident = `@?(?!(?:KW)(?!\w))[^\W\d]\w*+|@[^\W\d]\w*+`
name = ident (`\.|::` ident)*
string = `(?:@\$|\$@)"(?>[^"]+|"")*+"|@"(?>[^"]+|"")*+"(?:u8)?|\"\"\"+[\s\S]*?\"\"\"+|"(?>[^"\\\n]+|\\.)*+"(?:u8)?`
interpolated = ~`\$"` (~`(?>[^"\\{}\n]+|\\.|\{\{|\}\})++` / ~`\{` ws expr (~`,` ws expr)? ~`(?::[^}"]*)?\}`)* ~`"` ws
char = `'(?:[^'\\\n]|\\[xuU][\da-fA-F]+|\\.)'`
number = `(?:0[xX][\da-fA-F_]++|0[bB][01_]++|(?:\d[\d_]*+(?:\.\d[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)[uUlLfFdDmM]*+(?!\w)`
literal = string / number / char / `(?:true|false|null)(?!\w)`
attribute = '[' (ident ':' !':')? attrargs ']'
attrargs = attr1 (',' attr1)* `,`?
attr1 = name targs? ('(' args? ')')?
modifier = attribute / `(?:public|private|protected|internal|static|readonly|sealed|abstract|virtual|override|extern|unsafe|volatile|new(?=\s+\w)|const|fixed|async(?=\s+[\w<\[(])|partial(?=\s+\w)|required(?=\s+\w)|file(?=\s+\w)|ref(?=\s+(?:struct|partial|readonly|\w)))(?!\w)`
typedecl = modifier* (aggregate / enum / delegate)
aggregate = ("class" / "struct" / "interface" / "record" ("class" / "struct")?) ident tparams? params? (':' type ('(' args? ')')? (',' type)*)? constraint* ('{' member* '}' `;`? / `;`)
enum = "enum" ident (':' type)? '{' (attribute* ident ('=' expr)? (',' attribute* ident ('=' expr)?)* `,`?)? '}' `;`?
delegate = "delegate" type ident tparams? params constraint* `;`
constraint = "where" ident ':' (("class" / "struct") `\??` / "new" '(' ')' / "notnull" / "unmanaged" / "default" / type) (',' (("class" / "struct") `\??` / "new" '(' ')' / type))*
member = qmethod block / qprop / modifier* (aggregate / enum / delegate / special / method / property / field)
qmod = (`(?:public|private|protected|internal|static|override|virtual)(?!\w)`)*
qtype = `(?:[A-Za-z]\w*+(?:<[\w, ]*+>)?)(?:\[\])?\??(?=\s)`
qmethod = qmod !`(?:class|struct|interface|enum|record|delegate|event|using|namespace|new|return|implicit|explicit|operator)(?!\w)` qtype ident qparams
qparams = '(' (qparam (',' qparam)*)? ')'
qparam = !`(?:this|ref|out|in|params)(?!\w)` qtype ident ('=' literal)? &`[,)]`
qprop = qmod !`(?:class|struct|interface|enum|record|delegate|event|new|return)(?!\w)` qtype ident '{' "get" `;` ("set" `;`)? '}'
special = "event" type (ident (',' ident)* `;` / name '{' (attribute* ("add" / "remove") block)* '}') / `~` ident params (block / '=>' expr `;`) / ident params (':' ("base" / "this") '(' args? ')')? body / ("implicit" / "explicit") "operator" type params body / type "operator" `[^\s(\w]++|true|false` params body / type "this" '[' param (',' param)* ']' propbody
method = type (type `\.`)? name tparams? params constraint* body
body = block / '=>' expr `;` / `;`
property = type name propbody
propbody = '{' (attribute* accmod* ("get" / "set" / "init") body)+ '}' ('=' expr `;`)? / '=>' expr `;`
accmod = `(?:public|private|protected|internal|readonly)(?!\w)`
field = type declarator (',' declarator)* `;`
declarator = ident ('[' expr ']')? ('=' init)?
init = '{' ((literal (',' literal)* `,`? &`\}`) / init (',' init)* `,`?)? '}' / "ref"? expr / "stackalloc" expr
params = '(' (param (',' param)*)? ')'
param = attribute* (`(?:this|ref|out|in|params|scoped|readonly)(?!\w)`)* type ident ('=' expr)?
tparams = '<' attribute* (`(?:in|out)(?!\w)`)? ident (',' attribute* (`(?:in|out)(?!\w)`)? ident)* '>'
targs = '<' (type (',' type)* / `,`*) '>'
primitive = `(?:bool|byte|char|decimal|double|float|int|long|object|sbyte|short|string|uint|ulong|ushort|void)(?!\w)`
type = `ref(?!\w)`? `readonly(?!\w)`? (primitive / '(' type ident? (',' type ident?)+ ')' / "delegate" `\*` targs / ident targs? (`\.|::` ident targs?)*) (`\?(?![?.])(?=\s*[\w\[\])>,;(={])` / '[' `,`* ']' / `\*`)*
block = '{' statement* '}'
qname = `(?:(?:this|base)\.)?(?!(?:KW)(?!\w))[^\W\d]\w*+(?:\??\.[^\W\d]\w*+)*+` / `this(?![\w.])`
qatom = literal / qname
qargs = '(' (qatom (',' qatom)*)? ')'
qexpr = `!`? ("new" !`[\[{(]`)? qatom qargs? (`\.` ident qargs)* (binop `!`? qatom qargs?)*
quick = ("return" / "throw" / ("var" / qtype) ident '=' / qname `[+-]?=(?!>)`)? qexpr `;`
parens = '(' qexpr ')' / '(' expr ')'
local = modifier* ("var" / type) declarator (',' declarator)*
localfunc = modifier* type ident tparams? params constraint* (block / '=>' expr `;`)
statement = quick / !`[})]` other
other = `;` / block / "if" parens statement ("else" statement)? / "foreach" '(' ("var" ident "in" qexpr ')' / (("var" / type) (ident / tuplepat) / tuplepat) "in" expr ')') statement / "await" "foreach" '(' ("var" / type) ident "in" expr ')' statement / "for" '(' (local / exprs)? `;` expr? `;` exprs? ')' statement / "while" parens statement / "do" statement "while" parens `;` / "return" ("ref"? expr)? `;` / "throw" expr? `;` / trys / "switch" '(' expr ')' '{' (label+ statement*)* '}' / "break" `;` / "continue" `;` / "goto" ("case" expr / "default" / ident) `;` / "yield" ("return" expr / "break") `;` / "await"? "using" ('(' (local / expr) ')' statement / local `;`) / "lock" parens statement / ("checked" / "unchecked" / "unsafe") block / "fixed" '(' local ')' statement / localfunc / local `;` / ident ':' statement / expr `;`
tuplepat = '(' (("var" / type) ident / ident / tuplepat) (',' (("var" / type) ident / ident / tuplepat))* ')'
label = "case" pattern ("when" expr)? ':' / "default" ':'
trys = "try" block ("catch" ('(' type ident? ')')? ("when" '(' expr ')')? block)* ("finally" block)?
pattern = patternand (`or(?!\w)` patternand)*
patternand = patternnot (`and(?!\w)` patternnot)*
patternnot = `not(?!\w)` patternnot / `[<>]=?` shift / '(' pattern ')' / "var" (ident / tuplepat) / '[' ((`\.\.` pattern? / pattern) (',' (`\.\.` pattern? / pattern))*)? ']' ident? / type? ('(' ((ident ':')? pattern (',' (ident ':')? pattern)*)? ')')? '{' ((name ':' pattern) (',' name ':' pattern)* `,`?)? '}' ident? / type '(' ((ident ':')? pattern (',' (ident ':')? pattern)*)? ')' ident? / type `(?!(?:or|and|when|not)(?!\w))` ident &`\s*[):;,&|?=}]|\s*(?:when|=>|and|or)` / shift
shift = unary (`[-+*/%]` unary)*
exprs = expr (',' expr)*
binop = `\?\?=?|>>>=?|>>=?|<<=?|&&|\|\||=(?![=>])|[=!<>]=|[+*/%&|^-]=|[+*/%&|^<>-]|\.\.`
expr = query / lambda / `\.\.` unary? / unary (binop (lambda / unary) / "is" pattern / "as" type / "switch" '{' (pattern ("when" expr)? '=>' expr (',' pattern ("when" expr)? '=>' expr)* `,`?)? '}' / "with" '{' (args `,`?)? '}' / `\?(?![.?\[])` expr ':' (lambda / expr) / "throw" unary)* / "throw" expr
query = "from" !`[.;=,)]` (type ident / ident) "in" expr clause+
clause = "where" expr / "let" ident '=' expr / "join" (type ident / ident) "in" expr "on" expr "equals" expr ("into" ident)? / "orderby" expr `(?:ascending|descending)(?!\w)`? (',' expr `(?:ascending|descending)(?!\w)`?)* / "select" expr / "group" expr "by" expr / "into" ident / "from" (type ident / ident) "in" expr
lambda = attribute* (`(?:static|async)(?!\w)(?=\s*[\w(])`)* (ident '=>' / '(' (ident (',' ident)*)? ')' '=>' / type? params '=>') (block / expr) / (`async(?!\w)`)? "delegate" params? block
cast = '(' type ')' !`[-+*&\[=?.,;:)<>]|is\b|as\b` unary
unary = `\+\+|--|[-+!~^&*](?!=)` unary / "await" unary / cast / postfix
postfix = primary suffix* (`\+\+|--|!(?!=)` suffix*)*
primary = literal / interpolated / "new" creator / "typeof" '(' type ')' / "nameof" '(' expr ')' / "default" ('(' type ')')? / "sizeof" '(' type ')' / ("checked" / "unchecked") '(' expr ')' / "stackalloc" type ('[' expr? ']')? init? / "this" / "base" / '[' ((`\.\.`? expr) (',' `\.\.`? expr)* `,`?)? ']' / primitive / "ref" expr / ident (targs &`[({.\])};,:?!=]`)? (`::` ident)? / '(' ((ident ':')? expr (',' (ident ':')? expr)*) ')' / tuplepat
creator = '(' args? ')' objinit? / '[' `,`* ']' init / '{' (args `,`?)? '}' / ctype ('(' args? ')' objinit? / '[' exprs ']' ('[' `,`* ']')* init? / ('[' `,`* ']')+ init / objinit)
ctype = (primitive / ident targs? (`\.|::` ident targs?)*) `\?`?
objinit = '{' (objitem (',' objitem)* `,`?)? '}'
objitem = '[' args ']' '=' init / ident '=' init / '{' args '}' / expr
suffix = `\?(?=[.\[])`? (`\.(?!\.)|->|::` ident (targs &`[({.\])};,:?!=]`)? / '[' args ']') / '(' args? ')'
args = arg (',' arg)*
arg = (ident ':' !':')? (`(?:ref|out|in)(?!\w)` (("var" / type) ident / expr) / expr)
"""

# ------------------------------------------------------------------ Rust
RUST_KW = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
RUST_SPACE = r"(?:\s++|//[^\n]*+|/\*(?>[^*/]+|\*(?!/)|/(?!\*)|/\*(?>[^*]+|\*(?!/))*+\*/)*+\*/)*+"
RUST = r"""
file = `\#![^\[][^\n]*`? inner* item* !`[\s\S]`
ident = `(?!(?:KW)(?!\w))(?:r\#)?[^\W\d]\w*+`
lifetime = `'[^\W\d]\w*+(?!')`
string = `[bc]?"(?>[^"\\]+|\\[\s\S])*+"|[bc]?r(\#*+)"[\s\S]*?"\1`
char = `b?'(?:[^'\\\n]|\\x[\da-fA-F]{2}|\\u\{[\da-fA-F_]+\}|\\.)'`
number = `(?:0x[\da-fA-F_]++|0b[01_]++|0o[0-7_]++|\d[\d_]*+(?:\.\d[\d_]*+|\.(?![.\w]))?(?:[eE][+-]?[\d_]++)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)`
literal = string / number / char / `(?:true|false)(?!\w)`
inner = `\#!` '[' tree* ']'
attr = `\#` '[' tree* ']'
tree = '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / literal / lifetime / `[^()\[\]{}\s"']`
vis = `pub(?!\w)(?:\s*\((?:crate|super|self|in [^)]*)\))?`
qitem = `pub(?!\w)`? "const" ident ':' `\w++` '=' literal `;`
item = qitem / attr* vis? (function / use / structs / enum / impl / trait / mod / const / typealias / externs / macrorules / macroitem)
use = "use" usetree `;`
usetree = `::`? ('{' (usetree (',' usetree)* `,`?)? '}' / `\*` / pathseg (`::` pathseg)* (`::` ('{' (usetree (',' usetree)* `,`?)? '}' / `\*`))? ("as" (ident / `_`))?)
pathseg = ident / `(?:self|Self|super|crate)(?!\w)`
structs = ("struct" / `union(?=\s+[A-Z])`) ident generics? (where? '{' (field (',' field)* `,`?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* `,`?)? ')' where? `;` / where? `;`)
field = attr* vis? ident ':' type
enum = "enum" ident generics? where? '{' (variant (',' variant)* `,`?)? '}'
variant = attr* vis? ident ('{' (field (',' field)* `,`?)? '}' / '(' (attr* vis? type (',' attr* vis? type)* `,`?)? ')')? ('=' expr)?
impl = "unsafe"? "impl" generics? `!`? type ("for" type)? where? '{' inner* assoc* '}'
trait = "unsafe"? `auto(?=\s+trait)`? "trait" ident generics? (':' bounds?)? where? '{' assoc* '}'
assoc = attr* vis? `default(?=\s+\w)`? (function / const / typealias / macroitem)
mod = "unsafe"? "mod" ident (`;` / '{' inner* item* '}')
const = ("const" / "static" "mut"?) (ident / `_(?!\w)`) generics? ':' type ('=' expr)? `;`
typealias = "type" ident generics? (':' bounds)? where? ('=' type)? where? `;`
externs = "unsafe"? "extern" ("crate" pathseg ("as" (ident / `_`))? `;` / string? '{' inner* (attr* vis? (function / const / typealias / macroitem))* '}')
macrorules = `macro_rules\s*!` ident ('{' tree* '}' / '(' tree* ')' `;` / '[' tree* ']' `;`)
macroitem = path `!(?!=)` ident? ('{' tree* '}' / '(' tree* ')' `;` / '[' tree* ']' `;`)
fnmods = (`(?:const|async|unsafe|safe)(?!\w)` / "extern" string?)*
function = fnmods "fn" ident generics? params ('->' type)? where? (block / `;`)
params = qparams / '(' (param (',' param)* `,`?)? ')'
qtype = `&?(?:[A-Za-z_]\w*+)(?:<(?:&?\w+)(?:, ?\w+)*>)?(?=\s*[,){])`
qparams = '(' ((`&?(?:mut )?self(?!\w)` &`[,)]` / ident ':' qtype) (',' ident ':' qtype)*)? ')'
param = attr* (`&`? lifetime? "mut"? "self" (':' type)? / `\.\.\.` / pattern ':' (type / `\.\.\.`))
generics = '<' (generic (',' generic)* `,`?)? '>'
generic = attr* (lifetime (':' lifetime? (`\+` lifetime)*)? / "const" ident ':' type ('=' (block / literal / ident))? / ident (':' bounds?)? ('=' type)?)
where = "where" (wherep (',' wherep)* `,`?)?
wherep = lifetime ':' lifetime (`\+` lifetime)* / ("for" generics)? type ':' bounds?
bounds = bound (`\+` bound)* `\+`?
bound = lifetime / `\?|~const`? ("for" generics)? '(' bound ')' / `\?|~`? ("for" generics)? path / "use" genericargs
type = qtype / "impl" bounds / "dyn" bounds / `&&?` lifetime? "mut"? type / `\*(?:const|mut)(?!\w)` type / '(' (type (',' type)* `,`?)? ')' / '[' type (`;` expr)? ']' / `!` / `_(?!\w)` / ("for" generics)? fnmods "fn" '(' ((ident / `_`) ':')? (type (',' ((ident / `_`) ':')? type)* (',' `\.\.\.`)? `,`?)? ')' ('->' type)? / qself / path `!` '(' tree* ')' / ("for" generics)? path
qself = '<' type ("as" path)? '>' (`::` pathseg genericargs?)+
path = `::`? typeseg (`::` typeseg)*
typeseg = pathseg (`::`? genericargs / '(' (type (',' type)* `,`?)? ')' ('->' type)?)?
genericargs = '<' (garg (',' garg)* `,`?)? '>'
garg = lifetime / ident genericargs? ('=' type / ':' bounds) / type / block / `-`? literal
exprpath = qself / `::`? pathseg (`::` (genericargs / pathseg))*
block = '{' inner* statement* '}'
qname = `(?:self|(?!(?:KW)(?!\w))[^\W\d]\w*+)(?:\.[^\W\d]\w*+)*+(?![\w!])`
qpath = `(?:[^\W\d]\w*+::)+[^\W\d]\w*+(?![\w!:])`
qatom = literal / qpath / qname
qcall = `[&!*]?` qatom ('(' (`&?` qatom (',' `&?` qatom)*)? ')')? (`\.` ident '(' ((`\|` ident `\|` qname (binop qatom)? / qatom))? ')')*
qexpr = qcall ((`\.\.=?` / binop) qcall)*
quick = (`(?:debug|info|warn|error|println|eprintln|trace)!` '(' qatom (',' qatom)* ')' / ("return" / "let" "mut"? ident '=')? qexpr) `;`
statement = quick / !`\}` other
other = `;` / attr* ("let" pattern (':' type)? ('=' expr ("else" block)?)? `;` / stmtitem / blockexpr !`[.?]` `;`? / expr (`;` / &`\}`))
stmtitem = &`(?:pub|use|struct|enum|impl|trait|mod|static|type|extern|macro_rules|union|fn|const\s+(?!\{|move|\|)|async\s+fn|unsafe\s+(?:fn|impl|trait|extern))(?![\w])` item
blockexpr = "if" cond block ("else" (&"if" blockexpr / block))? / "match" scrut '{' inner* arm* '}' / (lifetime ':')? ("loop" block / "while" cond block / "for" pattern "in" scrut block / block) / "unsafe" block / "const" block / "async" "move"? block
cond = condpart (`&&` condpart)*
condpart = "let" pattern '=' scrutop / scrut
scrut = qexpr &`\{` / sexpr
scrutop = sexpr
arm = qarm / attr* `\|`? pattern ("if" cond)? '=>' (blockexpr !`[.?+*/-]` `,`? / expr (`,` / &`\}`))
qarm = (ident '(' ident ')' / ident) '=>' (`return` qexpr / qexpr) `,`
pattern = `\|`? pat1 (`\|(?!\|)` pat1)*
pat1 = `&&?` "mut"? pat1 / ("ref")? "mut"? ident (`@` pat1)? !`::|[({!]|\.\.` / `_(?!\w)` / `\.\.(?![=\w])` / `-`? literal (`\.\.=?` (`-`? literal / exprpath)?)? / `\.\.=` (`-`? literal / exprpath) / '(' (pattern (',' pattern)* `,`?)? ')' / '[' (pattern (',' pattern)* `,`?)? ']' / "box" pat1 / "const" block / exprpath (`!` tree / '{' (patfield (',' patfield)* `,`?)? '}' / '(' (pattern (',' pattern)* `,`?)? ')' / `\.\.=?` (`-`? literal / exprpath))?
patfield = attr* (`\.\.` / (ident / number) ':' pattern / "ref"? "mut"? ident)
binop = `<<=|>>=|<<|>>|&&|\|\||=(?![=>])|[=!<>]=|[+*/%&|^-]=|[+*/%&|^<>]|-(?!>)`
expr = closure / ctrl / unary (`\.\.(?!=)` (closure / ctrl / unary)? / (`\.\.=` / binop) (closure / ctrl / unary) / "as" type)*
sexpr = closure / ctrl / sunary (`\.\.(?!=)` (!`\{` (closure / ctrl / sunary))? / (`\.\.=` / binop) !`\{` (closure / ctrl / sunary) / "as" type)*
ctrl = "return" expr? / "break" lifetime? expr? / "continue" lifetime? / `\.\.=` unary (binop unary)* / `\.\.(?!=)` (unary (binop unary)*)? / "yield" expr?
closure = `(?:static\s+)?(?:async\s+)?(?:move\s+)?(?=\|)` (`\|\|` / `\|` (attr* pattern1 (':' type)? (',' attr* pattern1 (':' type)?)* `,`?)? `\|`) ('->' type block / expr)
pattern1 = pat1
unary = `[-!*]|&&?\s*(?:raw\s+(?:const|mut)\b)?` "mut"? unary / postfix
sunary = `[-!*]|&&?` "mut"? sunary / spostfix
postfix = (blockexpr / primary structlit?) suffix*
spostfix = (blockexpr / primary) suffix*
structlit = '{' (fieldinit (',' fieldinit)* `,`?)? '}'
fieldinit = attr* (`\.\.` expr / (ident / number) ':' expr / ident)
primary = literal / '(' (expr (',' expr)* `,`?)? ')' / '[' ((literal (',' literal)* `,`? &`\]`) / expr (`;` expr / (',' expr)* `,`?))? ']' / exprpath `!(?!=)` ('(' tree* ')' / '[' tree* ']' / '{' tree* '}') / exprpath
suffix = `\?` / `\.(?!\.)` ("await" / number / `\d++(?:\.\d++)*` / ident (`::` genericargs)? ('(' (expr (',' expr)* `,`?)? ')')?) / '(' (expr (',' expr)* `,`?)? ')' / '[' expr ']'
"""

# ------------------------------------------------------------------ Go
GO_KW = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
GO_SPACE = r"(?:[ \t\r\n]++|//[^\n\x04]*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+"
GO = r"""
file = "package" ident semi ("import" (importspec / '(' (importspec semi)* (importspec)? ')') semi)* (top (semi / !`[\s\S]`))* !`[\s\S]`
semi = `[;\x04]`
importspec = (ident / `\.`)? string
ident = `(?!(?:KW)(?!\w))[^\W\d]\w*+`
string = `"(?>[^"\\\n\x04]+|\\.)*+"|\x60[^\x60]*+\x60`
char = `'(?:[^'\\\n]|\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\U[\da-fA-F]{8}|\\[0-7]{3}|\\.)'`
number = `(?:0[xX][\da-fA-F_.]++(?:[pP][+-]?\d++)?|0[bB][01_]++|0[oO][0-7_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)i?(?!\w)`
literal = string / number / char
top = function / decl
decl = "const" (constspec / '(' (constspec semi)* constspec? ')') / "var" (varspec / '(' (varspec semi)* varspec? ')') / "type" (typespec / '(' (typespec semi)* typespec? ')')
constspec = idents (type? '=' exprs)?
varspec = idents (type ('=' exprs)? / '=' exprs)
typespec = ident ('[' tparam (',' tparam)* `,`? ']' !`\x04`)? `=`? type
tparam = idents constraint
constraint = `~`? type (`\|` `~`? type)*
idents = ident (',' ident)*
function = "func" ('(' paramdecl `,`? ')')? ident ('[' tparam (',' tparam)* `,`? ']')? signature block?
signature = params (params / type)?
params = qparams / '(' ((paramdecl) (',' paramdecl)* `,`?)? ')'
qparams = '(' (ident qtype (',' ident qtype)*)? ')'
qtype = `(?:\[\])?\*?[^\W\d]\w*+(?:\.\w++)?(?=\s*[,)])`
paramdecl = ident `\.\.\.`? type / `\.\.\.`? type
type = '(' type ')' / `\*` type / '[' ']' type / '[' (`\.\.\.` / expr) ']' type / "map" '[' type ']' type / `<-`? "chan" `<-`? type / "func" signature / "struct" '{' (fielddecl (semi fielddecl)* semi?)? '}' / "interface" '{' (ielem (semi ielem)* semi?)? '}' / ident (`\.` ident)? ('[' type (',' type)* ']')?
fielddecl = (`\*`? ident (`\.` ident)? ('[' type (',' type)* ']')? string? &`[;\x04}]` / idents type string?)
ielem = ident signature / constraint
block = '{' statements '}'
statements = statement? (semi statement?)*
qname = `(?!(?:KW)(?!\w))[^\W\d]\w*+(?:\.[^\W\d]\w*+)*+`
qatom = literal / qname
qcall = `[!&*]?` qatom ('(' (qatom (',' qatom)*)? ')')?
qexpr = qcall (binop qcall)*
quick = ("return" qexpr (',' qexpr)* / "defer" qcall / qname (`:=|[-+*/|&^%]?=` qexpr / `\+\+|--`)? / qexpr) &`[;\x04}]`
statement = quick / !`[}\x04]` other
other = decl / block / ifs / fors / switch / select / "return" exprs? / "go" expr / "defer" expr / "goto" ident / "break" ident? / "continue" ident? / "fallthrough" / ident ':' !`=` statement? / simple
simple = exprs (`:=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=)` ("range" expr / exprs) / `\+\+|--` / `<-` expr)?
qhead = (`(?!(?:KW)(?!\w))[^\W\d]\w*+` `:=` qcall `;`)? qexpr &`\{`
ifs = "if" (qhead / (simplenb? `;`)? simplenb) block ("else" (ifs / block))?
simplenb = nexprs (`:=|(?:<<|>>|&\^|[-+*/%&|^])?=(?!=)` ("range" nexpr / nexprs) / `\+\+|--` / `<-` nexpr)? / "range" nexpr
fors = "for" (qname (',' qname)? `:=` "range" qcall &`\{` / simplenb? `;` simplenb? `;` simplenb? / simplenb)? block
switch = "switch" (simplenb? `;`)? simplenb? '{' (("case" (type / expr) (',' (expr / type))* / "case" exprs / "default") ':' statements)* '}'
select = "select" '{' (("case" simple / "default") ':' statements)* '}'
exprs = expr (',' expr)*
nexprs = nexpr (',' nexpr)*
binop = `&&|\|\||<-(?!)|<<|>>|&\^|[=!<>]=|[-+*/%&|^<>](?!=)`
expr = unary (binop unary)*
nexpr = nunary (binop nunary)*
unary = `<-|[-+!^*&]` unary / postfix
nunary = `<-|[-+!^*&]` nunary / npostfix
postfix = (complit / operand) (suffix / litvalue)*
npostfix = (ncomplit / operand) suffix*
complit = &`\[|map\b|struct\b` type litvalue
ncomplit = &`\[|map\b|struct\b` type litvalue
litvalue = '{' ((literal (',' literal)* `,`? &`\}`) / (element (',' element)* `,`?))? '}'
element = (litvalue / expr) (':' (litvalue / expr))?
operand = literal / "func" signature block? / '(' (expr / type) ')' / ident / type
suffix = `\.` (ident / '(' ("type" / type) ')') / '[' (expr? ':' expr? (':' expr)? / (expr / type) (',' (expr / type))* `,`?) ']' / '(' ((expr / type) (',' (expr / type))* `\.\.\.`? `,`?)? ')'
"""

_GO_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,9})'|//[^\n]*|/\*[\s\S]*?\*/|\n|[^\W\d]\w*|[\d.][\w.]*|\+\+|--|[^\s]|[ \t\r]+")
_GO_OPEN = frozenset("break continue fallthrough return ++ -- ) ] }".split())


def go_layout(text: str) -> str:
    """Line ends after which the language inserts a semicolon become \\x04; the length stays."""
    if "\x04" in text:
        return text.replace("\x04", "\x05")
    out, last = [], ""
    for m in _GO_TOKEN.finditer(text):
        t = m[0]
        c = t[0]
        if c == "\n":
            if last:
                out.append("\x04")
                last = ""
            else:
                out.append(t)
            continue
        out.append(t)
        if c in " \t\r" or t.startswith("//"):
            continue
        if t.startswith("/*"):
            if "\n" in t and last:
                out[-1] = "\x04" + " " * (len(t) - 1)
                last = ""
            continue
        is_end = t in _GO_OPEN or c in "\"`'" or c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()) or ((c.isalpha() or c == "_") and t not in _GO_WORDS)
        last = t if is_end else ""
    if last:
        out.append("\x04")
    return "".join(out)


_GO_WORDS = frozenset(GO_KW.split()) - {"break", "continue", "fallthrough", "return"}

# ------------------------------------------------------------------ PHP
PHP_KW = "abstract and as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield"
PHP_SPACE = r"(?:\s++|(?://|\#(?!\[))(?>[^\n?]+|\?(?!>))*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+"
PHP = r"""
file = html? (`<\?php(?!\w)|<\?=` statement* (`\?>` html?)?)* !`[\s\S]`
html = `(?>[^<]+|<(?!\?))++`
end = `;` / &`\?>` / close
close = `\?>` html? (`<\?php(?!\w)|<\?=` / !`[\s\S]`)
ident = `(?!(?i:KW)(?!\w))[^\W\d]\w*+`
word = `[^\W\d]\w*+`
name = `(?:\\|namespace\\)?(?!(?i:KW)(?![\w\\]))[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+` / "static"
var = `\$[^\W\d]\w*+` / `\$+` (`\$[^\W\d]\w*+` / '{' expr '}')
string = `b?"(?>[^"\\]+|\\[\s\S])*+"|b?'(?>[^'\\]+|\\[\s\S])*+'|\x60(?>[^\x60\\]+|\\[\s\S])*+\x60|<<<[ \t]*["']?(\w+)["']?\n(?:[\s\S]*?\n)??[ \t]*\1(?!\w)`
number = `(?:0[xX][\da-fA-F_]++|0[bB][01_]++|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)(?!\w)`
literal = string / number
attr = `\#\[` (name ('(' args? ')')? (',' name ('(' args? ')')?)* `,`?) ']'
modifier = `(?i:public|private|protected|static|abstract|final|readonly|var)(?!\w)(?:\(set\))?`
type = `\?`? (name / `(?i:array|callable|static|null|false|true)(?!\w)` / '(' type ')') (`[|&](?!\s*(?:\.\.\.|\$|&))` type)*
block = '{' statement* '}'
qvar = `\$\w++(?:->\w++)*+`
qatom = literal / qvar / `(?:true|false|null|[A-Z][A-Z_]*)(?![\w\\:(])`
qcall = `!`? (`[a-z_]\w*+(?=\()` '(' (qatom (',' qatom)*)? ')' / qatom ('[' qatom ']')? (`->` word '(' (qatom (',' qatom)*)? ')')* / qvar '(' (qatom (',' qatom)*)? ')')
qfn = "fn" '(' qvar ')' '=>' qvar ('[' qatom ']')? (binop qatom)?
qlist = '[' (qatom '=>' (qfn / qcall) (',' qatom '=>' (qfn / qcall))* `,`?)? ']'
qfull = qlist / `array_\w++` '(' qatom ',' qfn ')' / qcall (binop qcall)*
quick = ("return" / qvar ('[' qatom? ']')? '=')? qfull `;`
qparams = '(' (`\$\w++` ('=' (literal / '[' ']' / `(?:true|false|null)(?!\w)`))? (',' `\$\w++` ('=' (literal / '[' ']' / `(?:true|false|null)(?!\w)`))?)*)? ')'
statement = quick / !`\}` other
other = `;` / block / close / ifs / "foreach" '(' (qvar "as" qvar ')' / expr "as" (expr '=>')? `&`? expr ')') body4each / "for" '(' exprs? `;` exprs? `;` exprs? ')' body4for / "while" '(' expr ')' (':' statement* `(?i:endwhile)(?!\w)` end / statement) / "do" statement "while" '(' expr ')' end / "return" expr? end / "echo" exprs end / trys / switch / "break" number? end / "continue" number? end / "throw" expr end / "namespace" (name? block / name end) / "use" !`\(` usedecl end / "const" (word '=' expr (',' word '=' expr)*) end / "global" var (',' var)* end / "static" &`\$` (var ('=' expr)? (',' var ('=' expr)?)*) end / "unset" '(' exprs `,`? ')' end / "declare" '(' word '=' expr (',' word '=' expr)* ')' (end / block / statement) / "goto" ident end / classlike / attr* function / ident ':' !':' / expr end
body4each = ':' statement* `(?i:endforeach)(?!\w)` end / statement
body4for = ':' statement* `(?i:endfor)(?!\w)` end / statement
ifs = "if" '(' (`empty\s*\(` qvar ')' ')' / expr ')') (':' statement* ("elseif" '(' expr ')' ':' statement*)* ("else" ':' statement*)? `(?i:endif)(?!\w)` end / statement (`(?i:elseif|else\s+if)(?!\w)` '(' expr ')' statement)* ("else" statement)?)
trys = "try" block ("catch" '(' type var? ')' block)* ("finally" block)?
switch = "switch" '(' expr ')' ('{' case* '}' / ':' case* `(?i:endswitch)(?!\w)` end)
case = ("case" expr / "default") `[:;]` statement*
usedecl = `(?:function|const)(?!\w)`? usename (',' usename)*
usename = `\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+` (`\\` '{' `(?:function|const)(?!\w)`? word (`\\` word)* ("as" word)? (',' `(?:function|const)(?!\w)`? word (`\\` word)* ("as" word)?)* `,`? '}' / "as" word)?
function = "function" `&`? word params (':' type)? block
params = qparams / '(' (param (',' param)* `,`?)? ')'
param = attr* modifier* type? `&`? `\.\.\.`? `\$\w++` ('=' expr)? ('{' hook* '}')?
hook = attr* modifier* `&`? word params? ('=>' expr `;` / block / `;`)
classlike = attr* (`(?i:abstract|final|readonly)(?!\w)`)* ("class" word ("extends" name)? ("implements" names)? / "interface" word ("extends" names)? / "trait" word / `enum(?=\s+\w)` word (':' type)? ("implements" names)?) '{' member* '}'
names = name (',' name)*
member = "use" names (`;` / '{' (`[^{}]++`)? '}') / "case" word ('=' expr)? `;` / attr* modifier* (`const(?!\w)` (!`\w+\s*=` type)? word '=' expr (',' word '=' expr)* `;` / "function" `&`? word params (':' type)? (block / `;`) / type? `\$\w++` ('=' expr)? (',' `\$\w++` ('=' expr)?)* (`;` / '{' hook* '}'))
exprs = expr (',' expr)*
binop = `\?\?=?|<=>|\*\*=?|===?|!==?|<>|<<=?|>>=?|&&|\|\||\.=|[-+*/%&|^]=|=(?![=>])|[<>]=?|\.(?!\d*\.\.)|[-+*/%&|^]` / "instanceof" / `(?i:and|or|xor)(?!\w)`
expr = unary (binop `&(?=\s*(?:\$|new\b))`? unary / `\?(?!->|>)` expr? ':' expr)*
unary = `\+\+|--|[-+!~@&]|\((?i:int|integer|float|double|string|bool|boolean|array|object|unset|binary)\)` unary / "new" newx suffix* / "clone" unary / "print" expr / "yield" ("from" expr / (expr ('=>' expr)?)?) / "throw" expr / `(?i:include|include_once|require|require_once)(?!\w)` expr / attr* "static"? "fn" `&`? params (':' type)? '=>' expr / attr* "static"? "function" `&`? params ("use" '(' (`&`? var (',' `&`? var)* `,`?)? ')')? (':' type)? block / postfix
newx = attr* (`readonly(?!\w)`)? "class" ('(' args? ')')? ("extends" name)? ("implements" names)? '{' member* '}' / (name / var (`(?:->|::)` (word / var))* / '(' expr ')') ('(' args? ')')?
postfix = primary suffix* `\+\+|--`?
primary = literal / var / '[' (element? (',' element?)*) ']' / `(?i:array|list)(?=\s*\()` '(' (element? (',' element?)*) ')' / "isset" '(' exprs `,`? ')' / "empty" '(' expr ')' / `(?i:exit|die)(?!\w)` ('(' expr? ')')? / "match" '(' expr ')' '{' (matcharm (',' matcharm)* `,`?)? '}' / '(' expr ')' / name
matcharm = ("default" / exprs `,`?) '=>' expr
element = (literal (',' literal)* `,`? &`\]`) / `\.\.\.` expr / expr ('=>' `&`? expr)? / `&` expr
suffix = '[' expr? ']' / `\??->` (word / var / '{' expr '}') / '::' (word / var / '{' expr '}') / '(' args? ')' / '{' expr '}' &`[\[;)]`
args = `\.\.\.` &`\)` / arg (',' arg)* `,`?
arg = (word ':' !':')? `\.\.\.`? `&`? expr
"""


def csharp() -> Grammar:
    return Grammar(CSHARP.replace("KW", "|".join(CSHARP_KW.split())) + "\nws = ~`" + CSHARP_SPACE + "`\n", CSHARP_SPACE, boundary=r"\w")


def rust() -> Grammar:
    return Grammar(RUST.replace("KW", "|".join(RUST_KW.split())), RUST_SPACE, boundary=r"\w")


def go() -> Grammar:
    return Grammar(GO.replace("KW", "|".join(GO_KW.split())), GO_SPACE, boundary=r"\w")


def php() -> Grammar:
    return Grammar(PHP.replace("KW", "|".join(PHP_KW.split())), PHP_SPACE, boundary=r"\w")
