"""Python, Ruby and SQL."""

import re

from lodestrata.llm.peg import Grammar

# ------------------------------------------------------------------ Python
PYTHON_KW = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
PYTHON_SPACE = r"[ \t\r\n\f]*+"
PYTHON = r"""
file = `\x04`* statement* !`[\s\S]`
nl = `\x04`
name = `(?!(?:KW)(?!\w))[^\W\d]\w*+`
string = (`(?i:[bru]|br|rb|fr|rf|f|t|tr|rt)?(?:\"\"\"(?>[^"\\]+|\\[\s\S]|"(?!""))*+\"\"\"|'''(?>[^'\\]+|\\[\s\S]|'(?!''))*+'''|"(?>[^"\\\n\x04]+|\\[\s\S])*+"|'(?>[^'\\\n\x04]+|\\[\s\S])*+')`)+
number = `(?:0[xX](?:_?[\da-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:\d(?:_?\d)*+(?:\.(?:\d(?:_?\d)*+)?)?|\.\d(?:_?\d)*+)(?:[eE][+-]?\d++)?[jJ]?)(?!\w)`
literal = string / number / "None" / "True" / "False"
block = nl `\x02` statement+ `\x03` / simples
simples = small (`;` small)* `;`? nl
statement = quick / !`\x03` (compound / simples)
qname = `(?!(?:KW)(?!\w))[^\W\d]\w*+(?:\.(?!(?:KW)(?!\w))[^\W\d]\w*+)*+`
qatom = literal / qname / '[' ']' / '{' '}'
qargs = '(' (qatom (',' qatom)*)? ')'
qcall = qatom (qargs / '[' qatom ']')*
qexpr = ("not")? qcall (`==|!=|[<>]=?|\*\*|//|[-+*/%&|^]` qcall)*
qcomp = '[' name "for" name "in" qcall ("if" qexpr)? ']'
qdict = '{' literal ':' qcall (',' literal ':' qcall)* '}'
quick = ("return" / "raise" / qname (`[-+*/]?=(?!=)`))? (qexpr / qcomp / qdict) nl
compound = decorator* ("async"? def / class) / qif / ifs / "while" named ':' block elseb? / "async"? "for" targets "in" starexprs ':' block elseb? / "try" ':' block (("except" `\*`? (expr ("as" name / (',' expr)+)?)? ':' block)+ elseb? ("finally" ':' block)? / "finally" ':' block) / "async"? "with" (`\(` withitem (',' withitem)* `,`? ')' &':' / withitem (',' withitem)*) ':' block / match / "async" compound
decorator = `@` named nl
def = "def" name tparams? params ('->' starexprs)? ':' block
class = "class" name tparams? ('(' args? ')')? ':' block
tparams = '[' tparam (',' tparam)* `,`? ']'
tparam = `\*{0,2}` name (':' expr)? ('=' expr)?
qparams = '(' (qparam (',' qparam)*)? ')'
qparam = name (':' `[A-Za-z_]\w*+(?:\[[\w, ]*+\])?(?=\s*[=,)])`)? ('=' qatom)? &`[,)]`
params = qparams / '(' (param (',' param)* `,`?)? ')'
param = `\*\*?` name (':' `\*?` expr)? / `\*` / `/` / name (':' expr)? ('=' expr)?
qif = "if" qexpr ':' block (elifs / elseb)?
ifs = "if" named ':' block (elifs / elseb)?
elifs = "elif" named ':' block (elifs / elseb)?
elseb = "else" ':' block
withitem = expr ("as" target)?
match = `match(?!\w)(?=\s*[^\s=.,:)\]])` starexprs ':' nl `\x02` (`case(?!\w)` patterns ("if" named)? ':' block)+ `\x03`
patterns = pattern (',' pattern)* `,`?
pattern = `\*` name / orpat ("as" name)?
orpat = closedpat (`\|` closedpat)*
closedpat = `[-+]?` number (`[-+]` number)? / literal / '(' (pattern (',' pattern)* `,`?)? ')' / '[' (pattern (',' pattern)* `,`?)? ']' / '{' (mappat (',' mappat)* `,`?)? '}' / name (`\.` name)* ('(' ((name '=' pattern / pattern) (',' (name '=' pattern / pattern))* `,`?)? ')')?
mappat = `\*\*` name / (literal / `-`? number / name (`\.` name)*) ':' pattern
small = "pass" / "break" / "continue" / "return" starexprs? / "raise" (expr ("from" expr)?)? / ("global" / "nonlocal") name (',' name)* / "del" targets / "assert" expr (',' expr)? / import / `type(?!\w)(?=\s+[^\W\d]\w*\s*[\[=])` name tparams? '=' expr / assign
import = "import" dotted ("as" name)? (',' dotted ("as" name)?)* / "from" (`\.+` dotted? / dotted) "import" (`\*` / '(' impname (',' impname)* `,`? ')' / impname (',' impname)*)
dotted = name (`\.` name)*
impname = name ("as" name)?
assign = starexprs (':' expr ('=' (yield / starexprs))? / (`(?:\*\*|//|>>|<<|[-+*/%@&|^])=` (yield / starexprs)) / ('=' (yield / starexprs))*) / yield ('=' (yield / starexprs))*
yield = "yield" ("from" expr / starexprs?)
targets = target (',' target)* `,`?
target = `\*`? postfix
starexprs = starexpr (',' starexpr)* `,`?
starexpr = `\*(?!\*)` bitor / named
named = name `:=` expr / expr
expr = lambda / disj ("if" disj "else" expr)?
lambda = "lambda" (lparam (',' lparam)* `,`?)? ':' expr
lparam = `\*\*?` name / `\*` / `/` / name ('=' expr)?
disj = inv (("or" / "and") inv)*
inv = "not" inv / bitor (cmp bitor)*
cmp = `==|!=|<=|>=|<(?!<)|>(?!>)` / "not" "in" / "in" / "is" "not"?
bitor = unary (`\*\*(?!=)|//(?!=)|<<(?!=)|>>(?!=)|[-+*/%@&|^](?!=)` unary)*
unary = `[-+~]` unary / "await"? postfix
postfix = (qcall / atom) suffix*
suffix = '(' args? ')' / '[' slices ']' / `\.` name
slices = slice (',' slice)* `,`?
slice = named? ':' expr? (':' expr?)? / starexpr
args = (arg (',' arg)* (',' keyed)* / keyed (',' keyed)*) `,`?
arg = `\*(?!\*)` expr / !keyed (name `:=` expr / expr compfor?)
keyed = `\*\*?` expr / name `=(?!=)` expr
compfor = ("async"? "for" targets "in" disj ("if" compcond)*)+
compcond = inv (("or" / "and") inv)* / lambda
atom = literal / name / `\.\.\.` / '(' (yield / starexpr (compfor / (',' starexpr)* `,`?))? ')' / '[' ((literal (',' literal)* `,`? &`\]`) / starexpr (compfor / (',' starexpr)* `,`?))? ']' / '{' (dictitem (compfor / (',' dictitem)* `,`?) / starexpr (compfor / (',' starexpr)* `,`?))? '}'
dictitem = `\*\*` bitor / expr ':' expr
"""

_PY_TOKEN = re.compile(
    r"(?i:\b(?:[bru]|br|rb|fr|rf|f|t|tr|rt))?(?:\"\"\"(?>[^\"\\]+|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?>[^'\\]+|\\[\s\S]|'(?!''))*+'''|\"(?>[^\"\\\n]+|\\[\s\S])*+\"|'(?>[^'\\\n]+|\\[\s\S])*+')"
    r"|\#[^\n]*|\\\r?\n|[([{]|[)\]}]|\n[ \t\f\r]*+(?:\#[^\n]*)?(?:\n[ \t\f\r]*+(?:\#[^\n]*)?)*+"
)


def python_layout(text: str) -> str:
    """Logical lines and blocks made visible: \\x04 ends a line, \\x02 and \\x03 open and close a block.

    Only \\x03 is inserted, all else keeps its place. Inconsistent indentation becomes \\x05, which no rule accepts.
    """
    if re.search(r"[\x02-\x05]", text):
        text = re.sub(r"[\x02-\x05]", "\x06", text)
    if text.startswith("\ufeff"):
        text = " " + text[1:]
    text = text.replace("\r\n", " \n")
    out, last, depth, stack = [], 0, 0, [0]
    started = False
    for m in _PY_TOKEN.finditer("\n" + text):
        t, a, b = m[0], m.start() - 1, m.end() - 1
        c = t[0]
        if c == "#":
            out += [text[last:a], " " * len(t)]
            last = b
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "\\":
            out += [text[last:a], " " * len(t)]
            last = b
        elif c == "\n":
            body = t[1:] if a < 0 else t
            if a >= 0:
                out.append(text[last:a])
            last = b
            if depth:
                out.append(re.sub(r"\#[^\n]*", lambda x: " " * len(x[0]), body))
                continue
            indent = t[t.rfind("\n") + 1 :]
            at_end = b >= len(text)
            if indent.lstrip(" \t\f\r").startswith("#"):
                indent = ""
                at_end = True  # a comment ends the file
            width = len(indent.expandtabs(8).replace("\f", "").replace("\r", ""))
            blank = re.sub(r"\#[^\n]*", lambda x: " " * len(x[0]), body)
            if at_end:
                width = 0
            first = "\x04" if started else ""
            blank = (first + blank[1:] if started and a >= 0 else blank).replace("\n", " ")
            if width > stack[-1] and started:
                stack.append(width)
                blank = blank[:-1] + "\x02"
                out.append(blank)
            elif width > stack[-1]:
                out.append(blank + "\x05")
            else:
                closing = ""
                while width < stack[-1]:
                    stack.pop()
                    closing += "\x03"
                if width != stack[-1]:
                    closing += "\x05"
                out.append(blank[:1] + closing + blank[1:] if blank else closing)
            if not at_end:
                started = True
    out.append(text[last:])
    if depth == 0 and started and not "".join(out).rstrip(" \t\x03").endswith("\x04"):
        out.append("\x04")
    out.append("\x03" * (len(stack) - 1))
    return "".join(out)


# ------------------------------------------------------------------ Ruby
RUBY_KW = "BEGIN END alias and begin break case class def defined\\? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"
RUBY_SPACE = r"[ \t\r\f\n]*+"
RUBY = r"""
file = stmts !`[\s\S]`
sep = `[;\x04][;\x04\s]*+`
stmts = sep? (stmt (sep stmt)*)? sep?
ident = `(?!(?:KW)(?![\w?!]))[a-z_\x80-\uffff]\w*+[?!]?(?!\w)`
local = `(?!(?:KW)(?![\w?!]))[a-z_\x80-\uffff]\w*+(?![\w?!])`
const = `[A-Z]\w*+[?!]?`
var = `@@?[^\W\d]\w*+|\$(?:[^\W\d]\w*+|\d+|[!@&~\x60'+*$?:"<>,.;/\\=-])`
symbol = `:(?:[^\W\d]\w*+[?!=]?(?![=~>])|[^\W\d]\w*+[?!]?|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[+-]@?|<<|>>|<=|>=|[*/%&|^~<>\x60]|@@?\w+|\$\w+)` / ~`:(?=["'])` string
interp = ~`\#\{` ws stmts ~`\}`
string = (~`"` (~`(?>[^"\\\#]+|\\[\s\S]|\#(?!\{))++` / interp)* ~`"(?::(?=\s))?` ws / `'(?>[^'\\]+|\\[\s\S])*+'(?::(?=\s))?` / ~`\x60` (~`(?>[^\x60\\\#]+|\\[\s\S]|\#(?!\{))++` / interp)* ~`\x60` ws / `%[qQwWiIxsr]?(?:\[[^\]]*+\]|\((?>[^()]+|\([^()]*\))*+\)|\{[^}]*+\}|<[^>]*+>|\|[^|]*+\||![^!]*+!)[imxounse]*` / `<<[~-]?(?:"\w+"|'\w+'|[A-Z_]\w*)` / `\?[^\s\w](?!\w)|\?\w(?!\w)`)+
regexp = ~`/(?![ =])` (~`(?>[^/\\\#\n]+|\\[\s\S]|\#(?!\{))++` / interp)* ~`/[imxounse]*+` ws / `//[imxounse]*`
number = `(?:0[xX][\da-fA-F_]++|0[bB][01_]++|0[oO]?[0-7_]++(?![.\d])|\d[\d_]*+(?:\.\d[\d_]*+)?(?:[eE][+-]?\d++)?)[ri]{0,2}(?!\w)`
literal = string / number / symbol / "nil" / "true" / "false"
qname = `(?:self\.|@)?(?!(?:KW)(?![\w?!]))[a-z_]\w*+(?:\.[a-z_]\w*+[?!]?)*+(?![\w?!:(\[{])`
qatom = literalq / qname
literalq = `"[^"\\\#]*+"(?!:)` / `'[^'\\]*+'(?!:)` / number / `(?:nil|true|false)(?![\w?!])`
qhash = '{' `[a-z_]\w*+:(?!:)` qatom (',' `[a-z_]\w*+:(?!:)` qatom)* '}'
qblock = '{' `\|[a-z_]\w*+\|` qatom (binop qatom)? '}'
quick = `def [a-z_]\w*+[?!]?` `;` (`@?[a-z_]\w*+(?:\[\d+\])?` `;`)? "end" &`[;\x04}]` / (qname `(?:=|<<|\+=)(?![=~>])` (qhash / qatom qblock / qatom) / `[a-z_.]++\(` literalq ')' / `raise ` const ',' literalq / qatom) &`[;\x04}]|end\b`
qcond = qname `(?=[ \t]*(?:\x04|;|then))`
qeach = qname `do[ \t]*\|[a-z_]\w*+\|` stmts "end" &`[;\x04}]|end\b`
qif = ("if" / "unless") qcond then stmts "end" &`[;\x04}]|end\b`
stmt = quick / qif / qeach / !`(?:end|else|elsif|when|rescue|ensure|then)(?![\w?!:])|\}` expr1 (("if" / "unless" / "while" / "until" / "rescue") expr1)*
expr1 = notexpr (("and" / "or") sepnl notexpr)*
sepnl = `[\x04\s]*+`
notexpr = "not" notexpr / special / massign / expr ("in" pattern / '=>' pattern)?
massign = &`\*|\(|[\w@$.?!:\[\]"' -]+,` mlhs '=' !`[=~>]` (mrhs)
mlhs = mitem (',' mitem)+ `,`? / mitem `,` &`\s*=(?![=~>])` / `\*` mitem
mitem = `\*`? (postfix / '(' mitem (',' mitem)* ')') / `\*`
mrhs = (`\*`? expr) (',' `\*`? expr)*
special = "alias" (symbol / var / fname) (symbol / var / fname) / "undef" (symbol / fname) (',' (symbol / fname))* / ("BEGIN" / "END") '{' stmts '}'
fname = `(?:self|[^\W\d]\w*)[?!=]?(?!\w)|\[\]=?|<=>|===?|=~|![=~]?|\*\*|[+-]@?|<<|>>|<=|>=|[*/%&|^~<>]`
binop = `\*\*=?|<=>|===?|=~|![=~]|<<=?|>>=?|&&=?|\|\|=?|\.\.\.?|[-+*/%&|^]=|=(?![=~>])|<=|>=|[-+*/%&|^<>](?![.])`
expr = unary (binop sepnl (("return" / "break" / "next") (args)? / unary) ("rescue" expr)? / `\?(?=\s)` sepnl expr sepnl `:` sepnl expr / `\.\.\.?`)*
unary = `[!~](?![=~])|-(?![\d=])|\+(?=\w)|&(?=[.\w:(@])|\*\*?(?=[\w(@\[{])|\.\.\.?` unary / "defined?" unary / "not" unary / postfix
postfix = (command / primary) suffix*
argstart = &`[ \t]++(?=["'\w@$:\[{(*&!~%/<?-]|->)(?!(?:if|unless|while|until|and|or|rescue|do|then|in|end)(?![\w?!:])|[-+*/&|<>=!?%^:](?:\s|=)|<<?[^~\w"'-]|&&|\|\||=|\*\*\s|\?\s|\.|\{|::\s)` ~`[ \t]++`
command = cmdname argstart args block? / ("return" / "break" / "next") !`(?:if|unless|while|until|and|or|rescue|end|;|\x04|\}|\))` (mrhs) / "yield" !`[(\[]` argstartw args / "super" !`[(\[;\x04]` !`\.` argstartw args block?
argstartw = &`(?!(?:if|unless|while|until|and|or|rescue|do|then|in|end)(?![\w?!:])|[-+*/&|<>=!?%^:]?(?:\s|=)|[)\]};\x04,.?]|&&|\|\|)`
cmdname = ~`(?!(?:KW)(?![\w?!:]))[a-z_]\w*+[?!]?(?!\w|:(?!:))|[A-Z]\w*+(?=[ \t]+["'])`
suffix = '(' sepnl callargs? sepnl ')' block? / '[' sepnl callargs? sepnl ']' / block / (`&?\.(?!\.)|::` sepnl ('(' callargs? ')' / (~`[^\W\d]\w*+[?!]?` argstart args block? / methname)))
methname = `(?:[^\W\d]\w*+[?!]?|\[\]|[-+*/<>]|<=>|==|!)`
callargs = arg (sepnl ',' sepnl arg)* sepnl `,`?
args = arg (',' sepnl arg)*
arg = `\*\*?|&(?!&)` expr? / assoc / special2 / notexpr / `\.\.\.`
special2 = "not" expr
assoc = `(?:[^\W\d]\w*+[?!]?|"(?>[^"\\]+|\\.)*+"|'(?>[^'\\]+|\\.)*+'):(?!:)` sepnl (notexpr)? / expr '=>' sepnl notexpr
block = '{' blockparams? stmts '}' / "do" blockparams? bodystmt "end"
blockparams = sepnl `\|` (bparam (',' bparam)* `,`?)? (`;` ident (',' ident)*)? `\|` / sepnl `\|\|`
bparam = `\*\*?` ident? / `&` ident? / '(' bparam (',' bparam)* ')' / `[a-z_]\w*+:(?!:)` unary? / ident (`=(?!=)` bdefault)?
bdefault = literal / postfix
params = '(' sepnl (param (sepnl ',' sepnl param)*)? sepnl ')' / param (',' param)*
param = `\*\*` (ident / "nil")? / `\*` ident? / `&` ident? / `\.\.\.` / '(' param (',' param)* ')' / `[a-z_]\w*+:(?!:)` (!`[,)\x04]` expr)? / ident (`=(?!=)` expr)?
bodystmt = stmts ("rescue" rescuehead ("then" / sep)? stmts)* ("else" stmts)? ("ensure" stmts)?
rescuehead = (`\*`? unary (',' sepnl `\*`? unary)*)? ('=>' postfix)?
then = sep? "then" / sep
primary = literal / regexp / lambda / "if" (qcond / expr1) then stmts ("elsif" expr1 then stmts)* ("else" stmts)? "end" / "unless" (qcond / expr1) then stmts ("else" stmts)? "end" / ("while" / "until") expr1 (sep / "do") stmts "end" / "for" mitem (',' mitem)* "in" expr1 (sep / "do") stmts "end" / case / def / "class" `<<` expr1 sep bodystmt "end" / ("class" cpath (`<(?!<)` expr)? / "module" cpath) sep bodystmt "end" / "begin" bodystmt "end" / array / hash / '(' stmts ')' / "yield" ('(' callargs? ')')? / "super" ('(' callargs? ')')? block? / "self" / "return" / "break" / "next" / "redo" / "retry" / "defined?" '(' expr1 ')' / `::` const / const / var / ident / `__\w+__`
cpath = `::`? const (`::` const)*
lambda = '->' ('(' (param (',' param)*)? ')' / param (',' param)*)? block
array = '[' sepnl (literal (',' sepnl literal)* sepnl `,`? sepnl &`\]`) ']' / '[' sepnl callargs? sepnl ']'
hash = '{' sepnl (hashitem (sepnl ',' sepnl hashitem)* sepnl `,`?)? sepnl '}'
hashitem = `\*\*` expr / assoc
def = "def" (`self|[a-zA-Z_]\w*` `\.`)? fname (params? `=(?![=~>])` sepnl stmt / (params? (sep / &"end" / &`[^\s]`) bodystmt "end"))
case = "case" expr1? sep? (("when" `\*`? expr (',' sepnl `\*`? expr)* then stmts)+ / ("in" pattern ((("if" / "unless") expr1))? then stmts)+) ("else" stmts)? "end"
pattern = pat (`\|` pat)* ('=>' ident)? (',' pat)*
pat = '[' sepnl (pattern)? sepnl ']' / '{' sepnl (patkey (sepnl ',' sepnl patkey)*)? sepnl '}' / patkey (',' patkey)* / `\*` ident? / `\^` (ident / var / '(' expr ')') / '(' pattern ')' / const (`::` const)* ('(' pattern? ')' / '[' pattern? ']')? / literal (`\.\.\.?` literal?)? / regexp / ident / "nil"
patkey = `[a-z_]\w*+:(?!:)` pat? / `\*\*` (ident / "nil")
"""

_RB_TOKEN = re.compile(
    r"^=begin\b[\s\S]*?^=end\b[^\n]*|^__END__$[\s\S]*|\"(?>[^\"\\\#]+|\\[\s\S]|\#\{(?>[^{}\"]+|\{[^{}]*\}|\"[^\"\n]*\")*+\}|\#)*+\"|'(?>[^'\\]+|\\[\s\S])*+'|`(?>[^`\\]+|\\[\s\S])*+`"
    r"|%[qQwWiIxsr]?(?:\[[^\]]*+\]|\((?>[^()]+|\([^()]*\))*+\)|\{[^}]*+\})|<<[~-]?(?:\"\w+\"|'\w+'|[A-Z_]\w*)|\#[^\n]*|\\\r?\n|\n|:\"(?>[^\"\\]+|\\.)*+\"|\$[^\w\s]|\?[^\s\w]|[^\W\d]\w*[?!]?|@@?\w+|\d[\w.]*|&&|\|\||=>|->|<<|\.\.\.?|[^\s]|[ \t\r\f]+",
    re.M,
)
_RB_REGEX = re.compile(r"/(?![ =\n])(?>[^/\\\n\[]+|\\.|\[(?>[^\]\\\n]+|\\.)*+\])*+/[imxounse]*")
_RB_GOES_ON = frozenset("and or not , ( [ { + - * / % & && || => = < > << . .. ... | ? : ! ~ ^ -> \\".split())
_RB_PREFIX = frozenset("( [ { , = => && || ! ~ | & < > + - * % ? : ; \n return if unless while until and or not when in puts elsif then do split match gsub sub scan".split())

_RB_HEAD = frozenset("\n ; then do else begin = { ( |".split(" "))


def ruby_layout(text: str) -> str:
    """Line ends that end a statement become \\x04; comments and here-document bodies become blanks."""
    text = re.sub(r"[\x02-\x05]", "\x06", text)
    out, at, last, stack, bars = [], 0, "\n", [], 0
    heredocs: list[str] = []
    loops: list[int] = []  # bracket depths of loop heads whose "do" is still to come
    n = len(text)
    blank = lambda s: " " * len(s)
    while at < n:
        if text[at] == "/" and last in _RB_PREFIX and (m := _RB_REGEX.match(text, at)):
            out.append(m[0].replace("#", "#"))
            last, at = "/r/", m.end()
            continue
        m = _RB_TOKEN.match(text, at)
        t = m[0]
        at = m.end()
        c = t[0]
        if c == "#" or t.startswith(("=begin", "__END__")) or c == "\\" and len(t) > 1:
            out.append(blank(t))
            continue
        if c == "\n":
            if heredocs:
                for tag in heredocs:
                    end = re.compile(rf"^[ \t]*{re.escape(tag)}[ \t]*\r?$", re.M).search(text, at)
                    stop = end.end() if end else n
                    out.append(blank(text[at:stop]) if end else "\x05")
                    at = stop
                heredocs = []
            rest = re.compile(r"(?:[ \t\r]*(?:\#[^\n]*)?\n)*[ \t\r]*(?:&\.|\.(?!\.))\w").match(text, at)
            inner = stack and stack[-1] in "(["
            closes = last == "|" and bars % 2 == 0 and bars
            go_on = inner or (last in _RB_GOES_ON and not closes) or rest
            out.append(" " if go_on else "\x04")
            if not go_on:
                last, bars = "\n", 0
                loops = [d for d in loops if d < len(stack)]
            continue
        if t == "do" and loops and loops[-1] == len(stack):
            # It ends the head of a loop, it opens no block.
            loops.pop()
            out.append("\x04 ")
            last = "\n"
            continue
        if t in ("while", "until", "for") and last in _RB_HEAD:
            loops.append(len(stack))
        out.append(t)
        if c in " \t\r\f":
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack:
            stack.pop()
        elif t in ("do", "def", "class", "module", "begin", "case", "if", "unless", "while") and stack and stack[-1] in "([" and last in ("(", "[", ",", "=", ")", "|"):
            pass
        if t == "|":
            bars += 1
        if t.startswith("<<") and len(t) > 2 and last in _RB_PREFIX | {"\n"} or t.startswith(("<<~", "<<-")) and len(t) > 3:
            heredocs.append(t.lstrip("<~-").strip("\"'"))
        last = t
    out.append("\x04")
    return "".join(out)


# ------------------------------------------------------------------ SQL
SQL_SPACE = r"(?:\s++|--[^\n]*+|\#[^\n]*+|/\*(?>[^*]+|\*(?!/))*+\*/)*+"
#: Words that cannot be a bare name in an expression.
SQL_KW = "select from where group having order limit union except intersect and or not case when then else end in is null like between join on left right full inner outer cross values insert into update set delete create drop alter table as distinct all exists by with using"
SQL = r"""
file = batch* (statement (batch+ statement)* batch*)? !`[\s\S]`
batch = `;` / `(?:(?<=\n)|(?<![\s\S]))(?i:go)(?=[ \t]*+\d*+[ \t]*+\r?(?:\n|\Z))\s*+\d*+`
ident = `(?!(?i:KW)(?!\w))[^\W\d][\w$]*+|"(?>[^"]+|"")++"|\x60[^\x60]++\x60|\[[^\]\n]++\]`
word = `[^\W\d][\w$]*+|"(?>[^"]+|"")++"|\x60[^\x60]++\x60`
name = word (`\.` (word / `\*`))*
string = (`(?:[eEnNxXbB]|[uU]&)?'(?>[^'\\]+|''|\\[\s\S])*+'|\$(\w*)\$[\s\S]*?\$\1\$`)+
number = `(?:0[xX][\da-fA-F]++|(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?)(?!\w)`
literal = string / number / K_null / K_true / K_false / K_default / K_current_timestamp
quick = K_insert K_into ident ('(' ident (',' ident)* ')')? K_values '(' (`-`? number / string / K_null) (',' (`-`? number / string / K_null))* ')' &`;|\Z`
statement = quick / query / insert / update / delete / create / alter / drop / other
insert = (K_insert (K_or word)? K_ignore? / K_replace) K_into? name (K_as? ident)? ('(' name (',' name)* ')')? (K_default K_values / K_values tuple (',' tuple)* / query) (K_on word word ('(' word (',' word)* ')')? K_do? (K_nothing / K_update (K_set setitem (',' setitem)* (K_where expr)? / setitem (',' setitem)*)))? returning?
tuple = '(' (expr (',' expr)*)? ')'
returning = K_returning selectitem (',' selectitem)*
update = with? K_update name (K_as? ident)? K_set setitem (',' setitem)* (K_from tables)? (K_where expr)? returning?
setitem = name '=' expr / '(' name (',' name)* ')' '=' expr
delete = with? K_delete K_from name (K_as? ident)? (K_using tables)? (K_where expr)? returning?
with = K_with K_recursive? cte (',' cte)*
cte = ident ('(' ident (',' ident)* ')')? K_as (K_not? K_materialized)? '(' (query / insert / update / delete) ')'
query = with? queryterm ((K_union / K_except / K_intersect / K_minus) (K_all / K_distinct)? queryterm)* (K_order K_by orderitem (',' orderitem)*)? (K_limit expr (',' expr)?)? (K_offset expr (K_rows / K_row)?)? (K_fetch (K_first / K_next) number? (K_rows / K_row) K_only)? (K_for (K_update / K_share))?
queryterm = select / '(' query ')' / K_values tuple (',' tuple)*
select = K_select (K_distinct (K_on '(' expr (',' expr)* ')')? / K_all / K_top number)? selectitem (',' selectitem)* (K_into name)? (K_from tables)? (K_where expr)? (K_group K_by expr (',' expr)*)? (K_having expr)? (K_window ident K_as window (',' ident K_as window)*)? (K_qualify expr)?
selectitem = `\*` / expr (K_as (ident / string) / !batch !K_qualify (ident / string))?
tables = tableref (',' tableref)*
tableref = tableitem (jointype tableitem (K_on expr / K_using '(' ident (',' ident)* ')')?)*
jointype = (K_natural? (K_inner / (K_left / K_right / K_full) K_outer? / K_cross)? K_lateral?) K_join
tableitem = (K_lateral? '(' query ')' / '(' tableref ')' / name ('(' (expr (',' expr)*)? ')')?) ((K_as / !batch !K_qualify) ident ('(' ident (',' ident)* ')')?)?
orderitem = expr (K_asc / K_desc)? (K_nulls (K_first / K_last))?
create = K_create (K_or K_replace)? (K_temporary / K_temp / K_global / K_local / K_unlogged / K_external)? (K_table ifnot? name (K_as query / K_like name / '(' (coldef (',' coldef)*)? ')' tableopt* (K_as query)?) / (K_materialized)? K_view ifnot? name ('(' ident (',' ident)* ')')? K_as query (K_with word* K_check K_option)? / K_unique? K_index K_concurrently? ifnot? name? K_on name (K_using word)? '(' indexcol (',' indexcol)* ')' (K_include tuple)? (K_where expr)? / (K_schema / K_database / K_extension / K_sequence / K_type / K_role / K_user / K_domain) rest / (K_function / K_procedure / K_trigger) rest)
ifnot = K_if K_not K_exists
coldef = constraint / word type colopt*
type = word (`\.` word)? `(?i:precision|varying|large\s+object|signed)(?!\w)`? ('(' (number / word / string) (',' (number / word / string))* ')')? (`(?i:with|without)(?!\w)` word word word)? (`\[` number? ']')* (K_unsigned)?
colopt = K_not K_null / K_null / K_primary K_key (K_autoincrement / K_asc / K_desc)? / K_unique / K_default (`-`? literal / '(' expr ')' / word tuple?) / K_references name ('(' word (',' word)* ')')? refopt* / K_check '(' expr ')' / K_collate word / K_constraint word / K_auto_increment / K_generated word K_as (K_identity tuple? / '(' expr ')' word?) / K_comment string
refopt = K_on (K_delete / K_update) (K_cascade / K_restrict / K_set (K_null / K_default) / K_no K_action) / K_deferrable / K_initially word / K_match word
constraint = (K_constraint word)? (K_primary K_key '(' indexcol (',' indexcol)* ')' / K_unique (K_key / K_index)? word? '(' indexcol (',' indexcol)* ')' / K_foreign K_key '(' word (',' word)* ')' K_references name ('(' word (',' word)* ')')? refopt* / K_check '(' expr ')' / (K_index / K_key) word? '(' indexcol (',' indexcol)* ')' / K_exclude rest1)
indexcol = expr (K_asc / K_desc)? (K_nulls (K_first / K_last))?
tableopt = !K_as word `=`? (word / literal / '(' rest1* ')')?
alter = K_alter rest
drop = K_drop (K_table / K_view / K_index / K_schema / K_database / K_type / K_sequence / K_function / K_trigger / K_extension / K_materialized K_view / K_column) (K_if K_exists)? name (',' name)* (K_cascade / K_restrict)?
other = (K_begin / K_commit / K_rollback / K_start / K_set / K_grant / K_revoke / K_truncate / K_use / K_pragma / K_explain / K_analyze / K_vacuum / K_copy / K_comment / K_call / K_do / K_lock / K_show / K_declare / K_savepoint / K_release / K_end / K_refresh / K_attach / K_merge) rest?
rest = rest1+
rest1 = '(' rest1* ')' / string / `[^;()'"]` / `"[^"]*"`
window = '(' (!K_partition !K_order !K_rows !K_range ident)? (K_partition K_by expr (',' expr)*)? (K_order K_by orderitem (',' orderitem)*)? ((K_rows / K_range / K_groups) rest1+)? ')'
expr = unary (binop unary / K_is K_not? (K_null / K_true / K_false / K_unknown / K_distinct K_from unary) / K_not? (K_in '(' (query / expr (',' expr)*) ')' / (K_like / K_ilike / K_similar K_to / K_rlike / K_regexp) unary (K_escape unary)? / K_between unary K_and unary) / K_collate word / K_at K_time K_zone unary / K_isnull / K_notnull)*
binop = `\|\||<=>|<>|!=|<=|>=|<<|>>|->>?|#>>?|@>|<@|!?~\*?|&&|::(?!)|[=<>+*/%&|^-]` / K_and / K_or / K_xor / K_div / K_mod
unary = `[-+~]` unary / K_not unary / K_exists '(' query ')' / (K_any / K_all / K_some) '(' (query / expr) ')' / primary (`::` type / `\[` expr (':' expr)? ']' / `\.` word)*
primary = K_case expr? (K_when expr K_then expr)+ (K_else expr)? K_end / K_cast '(' expr K_as type ')' / K_extract '(' word K_from expr ')' / K_interval (string / number) word? / '(' (query / expr (',' expr)*) ')' / K_array ('[' (expr (',' expr)*)? ']' / '(' query ')') / literal / (K_date / K_timestamp / K_time) string / `[?]|:\w+|\$\d+|@@?\w+|%\(\w+\)s|%s` / ident (`\.` (word / `\*`))* (funcargs (K_filter '(' K_where expr ')')? (K_over (window / ident))?)?
funcargs = '(' (`\*` / (K_distinct / K_all)? (expr (K_as type / K_from expr / K_for expr)* (',' expr)*)? (K_order K_by orderitem (',' orderitem)*)? (K_separator string)?) ')'
"""


def python() -> Grammar:
    return Grammar(PYTHON.replace("KW", "|".join(PYTHON_KW.split())), PYTHON_SPACE, boundary=r"\w")


def ruby() -> Grammar:
    return Grammar(RUBY.replace("KW", "|".join(RUBY_KW.split())) + "\nws = ~`[ \\t\\r\\f\\n]*+`\n", RUBY_SPACE, boundary=r"[\w?!]|:(?!:)")


def sql() -> Grammar:
    text = re.sub(r"\bK_(\w+)", lambda m: f"`(?i:{m[1]})(?!\\w)`", SQL.replace("KW", "|".join(SQL_KW.split())))
    return Grammar(text, SQL_SPACE, boundary=r"\w")
