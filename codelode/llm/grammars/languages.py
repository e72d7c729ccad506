"""Grammars and lexers of nine languages."""

from __future__ import annotations

from functools import lru_cache

from codelode.llm.grammars.engine import Compiled, Grammar
from codelode.llm.grammars.lexers import Lexer, PythonLexer, TemplateLexer

_C_SKIP = r"[ \t\r\n\f\v\u00a0]+|//[^\n]*|/\*[\s\S]*?\*/"
_NAME = r"[^\W\d]\w*"
_DQ, _SQ = r"\"(?:[^\"\\\n]|\\[\s\S])*\"", r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"0[xX][0-9a-fA-F_']+[uUlL]*|0[bB][01_']+[uUlL]*|0[oO][0-7_]+|(?:\d[\d_]*\.[\d_]+|\.\d[\d_]*|\d[\d_]*\.?(?![\w.])|\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"

# ---------------------------------------------------------------- Python
PYTHON = r"""
program <- stmt* EOF
stmt <- compound / simple
simple <= small (';' small)* ';'? NEWLINE
small <- 'pass' / 'break' / 'continue' / 'return' starexprs? / 'raise' (test ('from' test)?)? / 'global' names / 'nonlocal' names / 'del' starexprs
       / 'assert' test (',' test)? / import / 'type' NAME typeparams? '=' test / assignment
names <= NAME (',' NAME)*
import <= 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' asname (',' asname)* ','? ')' / asname (',' asname)*)
asname <= NAME ('as' NAME)?
dotted <= NAME ('.' NAME)*
assignment <- target ':' test ('=' (yield / starexprs))? / target AUG (yield / starexprs) / (targets '=')* (yield / starexprs)
targets <- startarget (',' startarget)* ','? &'='
startarget <= '*'? target
target <- '(' targetlist? ')' !trailer / '[' targetlist? ']' !trailer / power_target
targetlist <= startarget (',' startarget)* ','?
power_target <- primary
block <- NEWLINE INDENT stmt+ DEDENT / simple
compound <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? / 'while' named ':' block ('else' ':' block)? / for / with / try / decorated / match
for <= 'for' exprs 'in' starexprs ':' block ('else' ':' block)?
with <= 'with' ('(' withitem (',' withitem)* ','? ')' ':' / withitem (',' withitem)* ':') block
withitem <- test ('as' startarget)?
try <= 'try' ':' block (('except' '*'? (test (',' test)* ('as' NAME)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
decorated <= ('@' named NEWLINE)* (async / def / class)
async <= 'async' (def / for / with)
def <- 'def' NAME typeparams? '(' params? ')' ('->' test)? ':' block
typeparams <= '[' ('*' / '**')? NAME (':' test)? ('=' test)? (',' ('*' / '**')? NAME (':' test)? ('=' test)?)* ','? ']'
params <- param (',' param)* ','?
param <= '/' / '**' NAME (':' test)? / '*' (NAME (':' startest)?)? / NAME (':' test)? ('=' test)? / BIN
startest <= '*'? test
class <- 'class' NAME typeparams? ('(' args? ')')? ':' block
match <- 'match' starexprs ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
patterns <- pattern (',' pattern)* ','?
pattern <- orpattern ('as' NAME)?
orpattern <= closed (BIN closed)*
closed <- '*' NAME / 'None' / 'True' / 'False' / STR+ / PM? NUM (PM NUM)? / '(' patterns? ')' / '[' patterns? ']' / '{' (keypat (',' keypat)* ','?)? '}' / dotted ('(' (argpat (',' argpat)* ','?)? ')')?
keypat <= '**' NAME / (PM? NUM / STR+ / dotted / 'None' / 'True' / 'False') ':' pattern
argpat <= NAME '=' pattern / pattern
yield <- 'yield' ('from' test / starexprs)?
starexprs <- starexpr (',' starexpr)* ','?
starexpr <= '*' bits / named
exprs <- exprstar (',' exprstar)* ','?
exprstar <= '*'? bits
named <- NAME ':=' test / test
test <- 'lambda' lparams? ':' test / or ('if' or 'else' test)?
lparams <- lparam (',' lparam)* ','?
lparam <= '/' / BIN / '**' NAME / '*' NAME? / NAME ('=' test)?
or <- not (('and' / 'or') not)*
not <= 'not'* cmp
cmp <= bits ((CMP / 'in' / 'not' 'in' / 'is' 'not'?) bits)*
bits <- unary ((BIN / PM / '*' / '@') unary)*
unary <= (PM / '~')* power
power <= 'await'? primary ('**' unary)?
primary <- atom trailer*
trailer <= '.' NAME / '(' args? ')' / '[' subs ']'
subs <= sub (',' sub)* ','?
sub <- test? ':' test? (':' test?)? / '*' bits / named
args <- arg (',' arg)* ','?
arg <- '**' test / '*' test / NAME '=' test / named compfor?
compfor <- ('async'? 'for' exprs 'in' or ('if' compcond)*)+
compcond <= 'lambda' lparams? ':' or / NAME ':=' or / or
atom <- NAME / NUM / STR+ / 'None' / 'True' / 'False' / '...' / '(' (yield / tuple)? ')' / '[' tuple? ']' / '{' dictset? '}'
tuple <= starexpr compfor / starexprs
dictset <= (pair / '**' bits) compfor / (pair / '**' bits) (',' (pair / '**' bits))* ','? / tuple
pair <- test ':' test
"""

# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_KEYWORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new null return super switch this throw true false try typeof var void while with yield await enum"
_JS_OPS = (
    "... === !== **= <<= &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << ** + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } @ #"
)
_JS_CLASSES = {
    "ASG": "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=", "BIN": "== != === !== <= >= && || ?? ** / % ^ <<", "PM": "+ -", "INC": "++ --", "NOT": "~",
}
_JS = r"""
program <- stmt* EOF
block <- '{' stmt* '}'
eos <= ';' / @eos
stmt <- block / ';' / import / export / decl / vardecl eos / if / for / while / do / jump / switch / try / label / with / exprstmt
exprstmt <= !'{' !'function' !'class' expr eos
label <- NAME ':' stmt
with <= 'with' '(' expr ')' stmt
if <- 'if' '(' expr ')' stmt ('else' stmt)?
while <= 'while' '(' expr ')' stmt
do <= 'do' stmt 'while' '(' expr ')' ';'?
for <- 'for' 'await'? '(' (forhead ('of' assign / 'in' expr) / (vardecl / expr)? ';' expr? ';' expr?) ')' stmt
forhead <= ('var' / 'let' / 'const') target / lhs
jump <= 'return' (@same !';' !'}' expr)? eos / ('break' / 'continue') (@same NAME)? eos / 'throw' @same expr eos / 'debugger' eos
switch <= 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
try <- 'try' block ('catch' ('(' target {T: type}? ')')? block ('finally' block)? / 'finally' block)
import <- 'import' (STR attrs? eos / {t:'type'? }importclause 'from' STR attrs? eos / {t:NAME '=' 'require' '(' STR ')' eos /} &('(' / '.') lhsimport eos)
lhsimport <= '(' expr ')' trailer* / '.' WORD trailer*
attrs <= 'with' object
importclause <- NAME (',' (ns / named))? / ns / named
ns <= '*' 'as' NAME
named <- '{' (spec (',' spec)* ','?)? '}'
spec <= {t:'type'? }(WORD / STR) ('as' (WORD / STR))?
export <- 'export' ('default' (func / class / assign eos) / '*' ('as' (WORD / STR))? 'from' STR attrs? eos / {t:'type' named ('from' STR)? eos / '=' expr eos / 'as' 'namespace' NAME eos /} named ('from' STR attrs?)? eos / decl / vardecl eos)
decl <- func / class {t:/ 'interface' NAME typeparams? ('extends' reference (',' reference)*)? objtype ';'? / 'type' NAME typeparams? '=' type eos / 'const'? 'enum' NAME '{' (enumitem (',' enumitem)* ','?)? '}' / ('namespace' / 'module') (STR / NAME ('.' NAME)*) block / 'declare' (decl / vardecl eos / 'global' block) / 'abstract' class / 'const' 'enum' NAME '{' (enumitem (',' enumitem)* ','?)? '}'}
enumitem <= (WORD / STR) ('=' assign)?
vardecl <- ('var' / 'let' / 'const') binding (',' binding)*
binding <- target {t:'!'? annotation? }('=' assign)?
target <- NAME / '[' (','* element (','+ element)* ','*)? ']' / '[' ','* ']' / '{' (prop (',' prop)* ','?)? '}'
element <= '...' target / target ('=' assign)?
prop <= '...' target / propname ':' target ('=' assign)? / NAME ('=' assign)?
func <- 'async'? 'function' '*'? NAME? {t:typeparams? }params {t:rettype? }{B}
params <- '(' (param (',' param)* ','?)? ')'
param <- decorator* {t:(('public' / 'private' / 'protected' / 'readonly') &(NAME / '{' / '['))* }('...' target {t:annotation?} / {t:'this' annotation /} target {t:'?'? annotation? }('=' assign)?)
decorator <- '@' lhs
class <- decorator* {t:'abstract'? }'class' NAME? {t:typeparams? }('extends' lhs{t: typeargs?})? {t:('implements' reference (',' reference)*)? }'{' member* '}'
member <- ';' / decorator* 'static' block / decorator* mods (method / field)
mods <- (('static' / 'async' / 'get' / 'set' / 'accessor' {t:/ 'readonly' / 'public' / 'private' / 'protected' / 'abstract' / 'override' / 'declare'}) &(propname / '*' / '['))*
method <- '*'? propname {t:'?'? typeparams? }params {t:rettype? }{B}
field <- {t:'[' NAME ':' type ']' annotation eos / }propname {t:('?' / '!')? annotation? }('=' assign)? eos
propname <- WORD / STR / NUM / '[' assign ']' / '#' WORD
expr <- assign (',' assign)*
assign <- arrow / 'yield' (@same ('*'? assign)?)? / lhs ('=' / ASG / '>' '>'? BIN) assign / cond
arrow <- 'async'? (NAME / {t:typeparams? }params {t:rettype? }) @same '=>' (block / assign)
cond <- bin ('?' assign ':' assign)?
bin <- unary (binop unary)* 
binop <= BIN / PM / '*' / '<' / '>' ('>' '>'?)? / '&' / '|' / 'in' / 'instanceof'
unary <- ('!' / NOT / PM / INC / 'typeof' / 'void' / 'delete' / 'await')* postfix
postfix <= lhs (@same INC)? {t:((('as' / 'satisfies') @same_type type))*}
lhs <- 'new'* primary trailer*
trailer <= '.' WORD / '.' '#' WORD / '?.' ('[' expr ']' / args / {t:typeargs args / }'#'? WORD) / '[' expr ']' / args / TPL / template {t:/ typeargs args / '!' !'=' @same}
args <- '(' (arg (',' arg)* ','?)? ')'
arg <= '...'? assign
template <- TPLH expr (TPLM expr)* TPLT
primary <- func / NAME / NUM / STR / TPL / template / REGEX / 'this' / 'super' / 'null' / 'true' / 'false' / 'let' / class / '(' expr ')' / array / object / 'import' (args / '.' WORD) / 'new' '.' NAME / '#' WORD &'in' {t:/ '<' type '>' unary}
array <- '[' (','* arg (','+ arg)* ','*)? ']' / '[' ','* ']'
object <- '{' (item (',' item)* ','?)? '}'
item <- '...' assign / propname ':' assign / objmods method / NAME ('=' assign)?
objmods <= (('async' / 'get' / 'set') &(propname / '*'))*
"""
_TS_TYPES = r"""
annotation <- ':' type
rettype <- ':' ('asserts' NAME ('is' type)? / (NAME / 'this') 'is' type / type)
typeparams <- '<' typeparam (',' typeparam)* ','? '>'
typeparam <= ('const' / 'in' / 'out' &NAME)* NAME ('extends' type)? ('=' type)?
typeargs <- '<' type (',' type)* '>'
type <- functype / union ('extends' union '?' type ':' type)?
functype <- typeparams? params '=>' (('asserts' NAME ('is' type)? / NAME 'is' type) / type) / 'abstract'? 'new' typeparams? params '=>' type
union <- '|'? inter ('|' inter)*
inter <- '&'? posttype ('&' posttype)*
posttype <- primtype (@same '[' type? ']')*
primtype <- '(' type ')' / 'typeof' ('import' '(' STR ')' / WORD) ('.' WORD)* typeargs? / ('keyof' / 'unique' / 'readonly' / 'infer') &(NAME / '(' / '[' / '{' / 'typeof') posttype / objtype / '[' (tupleitem (',' tupleitem)* ','?)? ']' / STR / PM? NUM / TPL / TPLH type (TPLM type)* TPLT / 'void' / 'null' / 'this' / 'true' / 'false' / 'import' '(' STR ')' ('.' WORD)* typeargs? / reference
tupleitem <- '...'? (NAME '?'? ':' type / type '?'?)
reference <- NAME ('.' WORD)* typeargs?
objtype <- '{' (sig (';' / ',' / @newline / &'}'))* '}'
sig <- mapped / ('new' / NAME &NAME)? typeparams? params rettype? / (('readonly' / 'get' / 'set') &(propname / '['))* ('[' NAME ':' type ']' annotation / '[' NAME 'in' type ('as' type)? ']' ('?')? annotation? / propname '?'? (typeparams? params rettype? / annotation?))
mapped <= PM? 'readonly'? '[' NAME 'in' type ('as' type)? ']' PM? '?'? annotation?
"""


def _flavour(source: str, typed: bool) -> str:
    """The grammar with or without the parts in {t:...}; {T: x} and {B} are a type annotation and a body."""
    text = _chosen(source, typed).replace("{T: type}?", "annotation?" if typed else "").replace("{B}", "(block / eos)" if typed else "block")
    return text.replace("@same_type ", "") + (_TS_TYPES if typed else "")


def _chosen(source: str, typed: bool) -> str:
    out, at = [], 0
    while at < len(source):
        if source.startswith("{t:", at):
            depth, end = 1, at + 3
            while depth:
                quoted = source[end] == "'"
                if quoted:
                    end = source.index("'", end + 1) + 1
                    continue
                depth += (source[end] == "{") - (source[end] == "}")
                end += 1
            out.append(_chosen(source[at + 3 : end - 1], typed) if typed else "")
            at = end
        else:
            out.append(source[at])
            at += 1
    return "".join(out)


# ---------------------------------------------------------------- shared by Java and C#
_JAVA_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long "
    "native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
)
_C_OPS = ">>>= ... <<= >>= -> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } @"
_C_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>= >>>=", "BIN": "== != <= >= && || / % ^ | <<", "PM": "+ -", "INC": "++ --", "NOT": "! ~"}
JAVA = r"""
program <- (annotation* 'package' qualified ';')? (import / ';')* (typedecl / ';')* EOF
import <= 'import' 'static'? qualified ('.' '*')? ';'
qualified <= NAME ('.' NAME)*
annotation <- '@' !'interface' qualified ('(' (annarg (',' annarg)* ','?)? ')')?
annarg <= NAME '=' annval / annval
annval <- annotation / '{' (annval (',' annval)* ','?)? '}' / ternary
modifier <- annotation / 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' / 'sealed' &WORD / 'non' PM 'sealed'
typedecl <- modifier* (class / enum / record / interface)
class <= 'class' NAME typeparams? ('extends' type)? ('implements' typelist)? ('permits' typelist)? body
interface <= '@'? 'interface' NAME typeparams? ('extends' typelist)? ('permits' typelist)? body
record <= 'record' NAME typeparams? params ('implements' typelist)? body
enum <= 'enum' NAME ('implements' typelist)? '{' (constant (',' constant)* ','?)? (';' member*)? '}'
constant <= annotation* NAME args? body?
typelist <= type (',' type)*
body <- '{' member* '}'
member <- ';' / 'static'? block / typedecl / modifier* typeparams? (NAME params? throws? block / type NAME params dims throws? (block / 'default' annval ';' / ';') / type NAME dims ('=' varinit)? (',' NAME dims ('=' varinit)?)* ';')
throws <= 'throws' typelist
typeparams <- '<' annotation* NAME ('extends' type ('&' type)*)? (',' NAME ('extends' type ('&' type)*)?)* '>'
params <- '(' (param (',' param)*)? ')'
param <= ('final' / annotation)* type '...'? ('this' / NAME dims)
dims <= ('[' ']')*
type <- annotation* (prim / NAME typeargs? ('.' annotation* NAME typeargs?)*) (annotation* '[' ']')*
prim <= 'int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'boolean' / 'void'
typeargs <- '<' (typearg (',' typearg)*)? '>'
typearg <= annotation* ('?' (('extends' / 'super') type)? / type)
block <- '{' stmt* '}'
local <- ('final' / annotation)* type NAME dims ('=' varinit)? (',' NAME dims ('=' varinit)?)*
varinit <- '{' (varinit (',' varinit)*)? ','? '}' / expr
stmt <- block / ';' / if / for / while / do / 'return' expr? ';' / 'break' NAME? ';' / 'continue' NAME? ';' / 'throw' expr ';' / 'assert' expr (':' expr)? ';' / 'synchronized' '(' expr ')' block / try / switchstmt / 'yield' !'=' !'.' !'(' expr ';' / NAME ':' stmt / local ';' / typedecl / exprstmt ';'
exprstmt <- INC unary / assignment / primary_stmt
primary_stmt <= lhs INC? @closed &(';' / ',' / ')')
if <- 'if' '(' expr ')' stmt ('else' stmt)?
while <= 'while' '(' expr ')' stmt
do <= 'do' stmt 'while' '(' expr ')' ';'
for <- 'for' '(' (('final' / annotation)* type NAME ':' expr / (local / exprstmt (',' exprstmt)*)? ';' expr? ';' (exprstmt (',' exprstmt)*)?) ')' stmt
try <- 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' ('final' / annotation)* type ('|' type / BIN type)* NAME ')' block)* ('finally' block)?
resource <= ('final' / annotation)* type NAME '=' expr / lhs
switchstmt <- 'switch' '(' expr ')' '{' case* '}'
case <- ('case' label (',' label)* / 'default') (':' stmt* / '->' (block / 'throw' expr ';' / expr ';'))
label <= 'default' / pattern ('when' expr)? / ternary
pattern <- type '(' (pattern (',' pattern)*)? ')' NAME? / 'final'? type NAME
expr <- lambda / assignment / ternary
assignment <- lhs ('=' / ASG / '>' '>' '>'? '=' / '>' '>=') expr
lambda <- (NAME / '(' (NAME (',' NAME)*)? ')' / params) '->' (block / expr)
ternary <- bin ('?' (lambda / ternary) ':' (lambda / ternary))?
bin <- unary (('instanceof' (pattern / 'final'? type)) / binop unary)*
binop <= BIN / PM / '*' / '&' / '<' / '>' ('>' '>'?)? / '>='
unary <- (PM / NOT / INC)* (cast / postfix)
cast <- '(' prim dims ')' unary / '(' type ('&' type)* ')' (lambda / !PM !INC unary)
postfix <= lhs INC*
lhs <- primary trailer*
trailer <= '.' (typeargs? NAME args? / 'new' annotation* NAME typeargs? args body? / 'this' / 'super' / 'class' / typeargs? 'super' args) / '[' expr ']' / '::' typeargs? (NAME / 'new')
primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' args? / 'super' (args / &('.' / '::')) / new / switchstmt / '(' expr ')' / type_ref / NAME args?
type_ref <= (prim dims / NAME typeargs? ('.' NAME typeargs?)* ('[' ']')+) ('.' 'class' / '::' 'new') / NAME typeargs ('.' NAME)* &'::'
new <- 'new' annotation* (prim / NAME typeargs? ('.' NAME typeargs?)*) (('[' expr ']')+ ('[' ']')* / ('[' ']')+ arrayinit / args body?)
arrayinit <= '{' (varinit (',' varinit)*)? ','? '}'
args <- '(' (expr (',' expr)*)? ')'
"""

_CS_KEYWORDS = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if "
    "implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static "
    "string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
)
_CS_OPS = ">>>= ... <<= >>= ??= => -> :: ++ -- && || ?? == != <= >= += -= *= /= %= &= |= ^= << .. + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } @"
_CS_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>= >>>= ??=", "BIN": "== != <= && || / % ^ | << ??", "PM": "+ -", "INC": "++ --"}
CSHARP = r"""
program <- ('extern' NAME NAME ';')* using* attr* (namespace / typedecl / ';' / topstmt)* EOF
topstmt <= !modword stmt
modword <= 'public' / 'private' / 'protected' / 'internal' / 'namespace'
using <- NAME? 'using' ('static' / 'unsafe')? (NAME '=')? type ';'
namespace <- 'namespace' qualified (';' using* (namespace / typedecl / ';')* / '{' using* (namespace / typedecl / ';')* '}' ';'?)
qualified <= NAME ('.' NAME / '::' NAME)*
attr <- '[' (WORD ':')? attrib (',' attrib)* ','? ']'
attrib <= type ('(' (arg (',' arg)*)? ')')?
modifier <- 'public' / 'private' / 'protected' / 'internal' / 'static' / 'abstract' / 'sealed' / 'virtual' / 'override' / 'readonly' / 'new' !'(' / 'extern' / 'unsafe' / 'volatile' / 'const' / 'ref' / 'fixed' / ('partial' / 'async' / 'required' / 'file') &WORD
typedecl <- attr* modifier* (class / enum / delegate)
class <- (('class' / 'struct' / 'interface') NAME / 'record' ('class' / 'struct')? NAME) typeparams? params? (':' type args? (',' type)*)? where* (body ';'? / ';')
enum <= 'enum' NAME (':' type)? '{' (attr* NAME ('=' expr)? (',' attr* NAME ('=' expr)?)* ','?)? '}' ';'?
delegate <= 'delegate' type NAME typeparams? params where* ';'
typeparams <- '<' attr* ('in' / 'out')? NAME (',' attr* ('in' / 'out')? NAME)* '>'
where <= 'where' NAME ':' constraint (',' constraint)*
constraint <= 'class' '?'? / 'struct' / 'new' '(' ')' / 'default' / type
body <- '{' member* '}'
member <- ';' / typedecl / attr* modifier* memberrest
memberrest <- ('~' / NOT)? NAME params (':' ('base' / 'this') args)? methodbody / 'event' type NAME (accessors / ('=' expr)? (',' NAME ('=' expr)?)* ';') / ('implicit' / 'explicit') 'operator' type params methodbody / type 'operator' opname params methodbody / type (type '.')? 'this' '[' param (',' param)* ']' (accessors / '=>' expr ';') / type explicit typeparams? params where* methodbody / type explicit (accessors ('=' expr ';')? / '=>' expr ';') / type declarator (',' declarator)* ';'
explicit <= (NAME typeargs? '.' / NAME '::')* NAME
declarator <= NAME ('[' expr ']')? ('=' varinit)?
opname <= PM / '!' / '~' / INC / 'true' / 'false' / '*' / BIN / '&' / '<' / '>' '>'? / '>='
methodbody <= block / '=>' expr ';' / ';'
accessors <- '{' (attr* modifier* NAME (block / '=>' expr ';' / ';'))* '}'
params <- '(' (param (',' param)*)? ')'
param <- attr* ('ref' / 'out' / 'in' / 'params' / 'this' / 'readonly' / 'scoped' &NAME)* type NAME ('=' expr)?
type <- basetype ('?' !unaryish / '*' &('>' / ',' / ')' / NAME / '*') / '[' ','* ']')*
unaryish <= NUM / STR / '(' / 'new' / 'null' / 'true' / 'false' / NAME (':' / '.' NAME ':' / ',' / '(')
basetype <- 'ref' 'readonly'? type / prim / '(' type NAME? (',' type NAME?)+ ')' / (NAME '::')? NAME typeargs? ('.' NAME typeargs?)*
prim <= 'int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'bool' / 'void' / 'string' / 'object' / 'decimal' / 'uint' / 'ulong' / 'ushort' / 'sbyte'
typeargs <- '<' (type (',' type)* / ','*) '>'
block <- '{' stmt* '}'
local <- ('const' / 'using' / 'await' 'using' / 'ref' / 'scoped' &NAME)* type declarator (',' declarator)*
varinit <- '{' (varinit (',' varinit)*)? ','? '}' / 'stackalloc' type ('[' expr ']')? / 'ref' expr / expr
localfunc <- attr* ('static' / 'unsafe' / 'extern' / 'async' &WORD)* type NAME typeparams? params where* methodbody
stmt <- block / ';' / if / for / foreach / while / do / 'return' ('ref'? expr)? ';' / 'break' ';' / 'continue' ';' / 'throw' expr? ';' / 'goto' ('case' expr / 'default' / NAME) ';' / try / switch / usingstmt / ('lock' / 'fixed') '(' (local / expr) ')' stmt / ('checked' / 'unchecked' / 'unsafe') block / 'yield' ('return' expr / 'break') ';' / NAME ':' stmt / local ';' / localfunc / exprstmt ';'
exprstmt <- assignment / 'await' unary / INC unary / deconstruct / callstmt
deconstruct <= '(' expr (',' expr)+ ')' '=' expr / 'var' '(' NAME (',' NAME)+ ')' '=' expr
callstmt <= lhs INC? @closed &(';' / ',' / ')')
usingstmt <= 'await'? 'using' '(' (local / expr) ')' stmt
if <- 'if' '(' expr ')' stmt ('else' stmt)?
while <= 'while' '(' expr ')' stmt
do <= 'do' stmt 'while' '(' expr ')' ';'
for <- 'for' '(' (local / exprstmt (',' exprstmt)*)? ';' expr? ';' (exprstmt (',' exprstmt)*)? ')' stmt
foreach <- 'await'? 'foreach' '(' (type NAME / 'var' '(' NAME (',' NAME)+ ')' / '(' type NAME (',' type NAME)+ ')') 'in' expr ')' stmt
try <- 'try' block ('catch' ('(' type NAME? ')')? ('when' '(' expr ')')? block)* ('finally' block)?
switch <- 'switch' '(' expr ')' '{' (('case' pattern ('when' expr)? ':' / 'default' ':')+ stmt+)* '}'
pattern <- patterm (('and' / 'or') patterm)*
patterm <- 'not'? (('<' / '>' / BIN / '>=') bin / '{' (subpat (',' subpat)* ','?)? '}' NAME? / '[' (pattern (',' pattern)*)? ','? ']' / '..' pattern? / type '(' (subpat (',' subpat)*)? ')' ('{' (subpat (',' subpat)*)? '}')? NAME? / type '{' (subpat (',' subpat)*)? '}' NAME? / type NAME !'(' / '(' (subpat (',' subpat)*)? ')' NAME? / bin)
subpat <= (NAME ('.' NAME)* ':')? pattern
expr <- lambda / assignment / query / 'throw' expr / ternary
query <- 'from' (type NAME / NAME) 'in' expr (&NAME queryclause)+
queryclause <= 'from' (type NAME / NAME) 'in' expr / 'where' expr / 'let' NAME '=' expr / 'join' (type NAME / NAME) 'in' expr 'on' expr 'equals' expr ('into' NAME)? / 'orderby' expr NAME? (',' expr NAME?)* / 'select' expr / 'group' expr 'by' expr / 'into' NAME
assignment <- lhs ('=' / ASG / '>' '>' '>'? '=' / '>' '>=') varinit
lambda <- attr* ('static' / 'async' &(NAME / '('))* (NAME / '(' (NAME (',' NAME)*)? ')' / type? params) '=>' (block / 'ref'? expr) / 'async'? 'delegate' params? block
ternary <- range ('?' (lambda / 'throw' expr / 'ref'? ternary) ':' (lambda / 'throw' expr / 'ref'? ternary))?
range <= bin? '..' bin? / bin
bin <- unary ('is' pattern / 'as' type / 'switch' '{' (pattern ('when' expr)? '=>' expr (',' pattern ('when' expr)? '=>' expr)* ','?)? '}' / 'with' '{' (NAME '=' expr (',' NAME '=' expr)* ','?)? '}' / binop ('throw' expr / unary))*
binop <= BIN / PM / '*' / '&' / '<' / '>' ('>' '>'?)? / '>='
unary <- (PM / '!' / '~' / INC / '&' / '*' / '^' / 'await' &(NAME / '(' / 'this' / 'base' / 'new'))* (cast / postfix)
cast <- '(' prim ('?' / '*' / '[' ','* ']')* ')' unary / '(' type ')' !PM !'*' !'&' !INC (lambda / unary)
postfix <= lhs INC*
lhs <- primary trailer*
trailer <= ('.' / '->' / '?' '.') NAME (typeargs &('(' / ')' / '.' / ';' / ','))? / '?'? '[' arg (',' arg)* ']' / args / '!' !'='
primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' / 'base' / new / ('typeof' / 'sizeof' / 'default') '(' type ')' / 'default' / ('checked' / 'unchecked') '(' expr ')' / '(' expr (',' expr)* ')' / '(' tuplearg (',' tuplearg)+ ')' / prim &'.' / (NAME '::')? NAME (typeargs &('(' / '.' / ')' / ';' / ','))? / '[' (arg (',' arg)* ','?)? ']'
tuplearg <= (NAME ':')? expr
new <- 'new' ('[' ','* ']' init / '(' (arg (',' arg)*)? ')' init? / '{' (NAME ('.' NAME)* ('=' expr)? (',' NAME ('.' NAME)* ('=' expr)?)* ','?)? '}' / basetype ('?')? ('[' expr (',' expr)* ']' ('[' ','* ']')* init? / ('[' ','* ']')+ init / args init? / init))
init <- '{' (initem (',' initem)* ','?)? '}'
initem <- '{' expr (',' expr)* '}' / '[' expr (',' expr)* ']' '=' varinit / NAME '=' varinit / expr
args <- '(' (arg (',' arg)*)? ')'
arg <- (NAME ':')? ('out' ('var' NAME / type NAME / lhs) / ('ref' / 'in') expr / expr)
"""

_C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned "
    "void volatile while _Bool _Atomic _Noreturn _Static_assert _Thread_local _Generic _Alignof _Alignas"
)
_CC_OPS = "... <<= >>= -> ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { }"
_CC_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>=", "BIN": "== != <= >= && || / % ^ | << >> < >", "PM": "+ -", "INC": "++ --", "NOT": "! ~"}
C = r"""
program <- external* EOF
external <- ';' / function / declaration / '_Static_assert' '(' expr (',' STR+)? ')' ';' / macro
macro <= NAME '(' (expr (',' expr)*)? ')' ';'
function <- specs? declarator declaration* block
declaration <- specs (init (',' init)*)? ';'
init <= declarator attribute* ('=' initializer)?
specs <- spec* (basic spec*)+ / spec* named spec* / spec+
spec <- 'static' / 'extern' / 'typedef' / 'inline' / 'register' / 'auto' / 'const' / 'volatile' / 'restrict' / '_Noreturn' / '_Thread_local' / '_Atomic' ('(' typename ')')? / '_Alignas' '(' (typename / expr) ')' / attribute
attribute <= NAME '(' '(' (attrword (',' attrword)*)? ')' ')'
attrword <= WORD ('(' (expr (',' expr)*)? ')')?
basic <= prim / struct / enum
named <= NAME &(NAME / '*' / 'const' / 'volatile' / 'restrict' / '(' '*' / ')' / ',' / '[' / ';' / 'static' / 'struct')
prim <= 'int' / 'char' / 'long' / 'short' / 'float' / 'double' / 'void' / 'signed' / 'unsigned' / '_Bool'
struct <- ('struct' / 'union') attribute? (NAME? '{' field* '}' / NAME) attribute?
field <= ';' / specs (fielddecl (',' fielddecl)*)? ';'
fielddecl <= declarator? ':' cond / declarator
enum <- 'enum' (NAME? '{' NAME ('=' cond)? (',' NAME ('=' cond)?)* ','? '}' / NAME)
declarator <- ('*' spec*)* direct
direct <- (NAME / '(' attribute? declarator ')') suffix*
suffix <= '[' ('static' / spec)* ('*' / assign)? ']' / '(' params? ')'
params <- param (',' param)* (',' '...')? / '...'
param <- specs (declarator / abstract)? / NAME
abstract <- ('*' spec*)+ absdirect? / absdirect
absdirect <- ('(' abstract ')' / absuffix) absuffix*
absuffix <= '[' ('*' / assign)? ']' / '(' params? ')'
typename <- specs abstract?
initializer <- '{' (designated (',' designated)* ','?)? '}' / assign
designated <= (('[' cond ('...' cond)? ']' / '.' NAME)+ '=')? initializer
block <- '{' (declaration / stmt)* '}'
stmt <- block / ';' / if / for / while / do / 'return' expr? ';' / 'break' ';' / 'continue' ';' / 'goto' NAME ';' / switch / ('case' cond ('...' cond)? / 'default') ':' (declaration / stmt)? / NAME ':' (declaration / stmt)? / expr ';'
if <- 'if' '(' expr ')' stmt ('else' stmt)?
while <= 'while' '(' expr ')' stmt
do <= 'do' stmt 'while' '(' expr ')' ';'
for <- 'for' '(' (declaration / expr? ';') expr? ';' expr? ')' stmt
switch <= 'switch' '(' expr ')' stmt
expr <- assign (',' assign)*
assign <- unary ('=' / ASG) assign / cond
cond <- bin ('?' expr? ':' cond)?
bin <- castexpr ((BIN / PM / '*' / '&') castexpr)*
castexpr <- '(' typename ')' ('{' (designated (',' designated)* ','?)? '}' trailer* / castexpr) / unary
unary <- INC unary / (PM / NOT / '*' / '&') castexpr / ('sizeof' / '_Alignof') ('(' typename ')' / unary) / postfix
postfix <- primary trailer*
trailer <= '.' NAME / '->' NAME / '[' expr ']' / '(' (assign (',' assign)*)? ')' / INC
primary <- NUM / (STR / NAME &STR)+ / NAME / '(' block ')' / '(' expr ')' / '_Generic' '(' assign (',' (typename / 'default') ':' assign)+ ')'
"""

_GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO_OPS = "... <<= >>= &^= := <- ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ ~ ! < > = : ; , . ( ) [ ] { }"
_GO_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "BIN": "== != <= >= && || / % | << >> &^ < >", "PM": "+ -", "INC": "++ --"}
GO = r"""
program <- 'package' NAME ';' ('import' (importspec / '(' (importspec ';')* importspec? ')') ';')* (decl ';')* EOF
importspec <= ('.' / NAME)? STR
decl <- func / 'type' (typespec / '(' (typespec ';')* typespec? ')') / vardecl
vardecl <- 'var' (varspec / '(' (varspec ';')* varspec? ')') / 'const' (constspec / '(' (constspec ';')* constspec? ')')
names <= NAME (',' NAME)*
varspec <= names (type ('=' exprs)? / '=' exprs)
constspec <= names (type? '=' exprs)?
typespec <= NAME typeparams? '='? type
typeparams <- '[' names union (',' names union)* ','? ']'
union <= ('~'? type) (BIN '~'? type)*
func <- 'func' params? NAME typeparams? signature block?
signature <- params result?
result <= params / type
params <- '(' (param (',' param)* ','?)? ')'
param <= names '...'? type / '...'? type
type <- '*' type / '[' (expr / '...')? ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' signature / struct / interface / '(' type ')' / NAME ('.' NAME)? typeargs?
typeargs <- '[' type (',' type)* ','? ']'
struct <- 'struct' '{' (field ';')* field? '}'
field <= (names type / '*'? NAME ('.' NAME)? typeargs?) STR?
interface <- 'interface' '{' (method ';')* method? '}'
method <= NAME signature / union
block <- '{' stmts '}'
stmts <= (stmt? ';')* stmt?
stmt <- decl / 'return' exprs? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / ('go' / 'defer') expr / if / for / switch / select / block / NAME ':' stmt? / simple
simple <- exprs (':=' exprs / '=' exprs / ASG expr / INC / '<-' expr)?
simpleh <- exprsh (':=' exprsh / '=' exprsh / ASG exprh / INC / '<-' exprh)?
if <- 'if' (simpleh? ';')? exprh block ('else' (if / block))?
for <- 'for' ((exprsh (':=' / '='))? 'range' exprh / simpleh? ';' exprh? ';' simpleh? / exprh)? block
switch <- 'switch' (simpleh? ';')? (NAME ':=' unaryh &'{' / simpleh)? '{' (('case' typeorexprs / 'default') ':' stmts)* '}'
typeorexprs <= (expr / type) (',' (expr / type))*
select <= 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
exprs <- expr (',' expr)*
exprsh <- exprh (',' exprh)*
expr <- unary (binop unary)*
exprh <- unaryh (binop unaryh)*
binop <= BIN / PM / '*' / '&' / '^'
unary <- (PM / '!' / '^' / '*' / '&' / '<-')* operand trailer*
unaryh <- (PM / '!' / '^' / '*' / '&' / '<-')* operandh trailerh*
trailer <- '.' (NAME / '(' ('type' / type) ')') / '[' (sliced / (expr / type) (',' (expr / type))* ','?) ']' / args / literal
trailerh <- '.' (NAME / '(' ('type' / type) ')') / '[' (sliced / (expr / type) (',' (expr / type))* ','?) ']' / args
sliced <= expr? ':' expr? (':' expr)?
args <- '(' ((expr / type) (',' (expr / type))* '...'? ','?)? ')'
operand <- NUM / STR / 'func' signature block / composite / '(' (expr / type) ')' / NAME / conversion
operandh <- NUM / STR / 'func' signature block / composite / '(' (expr / type) ')' / NAME / conversion
composite <- ('[' (expr / '...')? ']' type / 'map' '[' type ']' type / struct) literal
conversion <= ('[' expr? ']' type / 'map' '[' type ']' type / 'chan' type / 'func' signature / interface / struct) &'('
literal <- '{' (element (',' element)* ','?)? '}'
element <- ((literal / expr) ':')? (literal / expr)
"""

_RUST_KEYWORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
_RUST_OPS = "... ..= <<= >>= -> => :: && || == != <= >= += -= *= /= %= &= |= ^= << .. + - * / % & | ^ ! < > = ? : ; , . ( ) [ ] { } @ # $ ~"
_RUST_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>=", "BIN": "== != <= / % ^ <<", "PM": "+ -"}
RUST = r"""
program <- inner* item* EOF
inner <= '#' '!' '[' tree* ']'
attr <- '#' '[' tree* ']'
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !')' !']' !'}' !EOF any
any <= ANY
item <- attr* (vis? (use / func / struct / enum / union / trait / impl / mod / const / typealias / extern) / macro)
vis <= 'pub' ('(' ('crate' / 'self' / 'super' / 'in' path) ')')?
use <- 'use' '::'? usetree ';'
usetree <- '*' / '{' (usetree (',' usetree)* ','?)? '}' / segment ('::' segment)* ('::' ('*' / '{' (usetree (',' usetree)* ','?)? '}'))? ('as' NAME)?
segment <= NAME / 'self' / 'super' / 'crate' / 'Self'
func <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' NAME generics? '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? where? (block / ';')
fnparam <- attr* (('&' LIFE?)? 'mut'? 'self' (':' type)? / pattern ':' ('...' / type) / '...')
generics <- '<' (generic (',' generic)* ','?)? '>'
generic <= attr* (LIFE (':' LIFE (PM LIFE)*)? / 'const' NAME ':' type ('=' expr)? / NAME (':' bounds)? ('=' type)?)
bounds <- bound (PM bound)* / @eps
bound <= LIFE / '?'? ('for' generics)? typepath / '(' '?'? ('for' generics)? typepath ')' / '~'? 'const' typepath
where <- 'where' (wherep (',' wherep)* ','?)?
wherep <= LIFE ':' bounds / ('for' generics)? type ':' bounds
struct <- 'struct' NAME generics? (where? '{' (field (',' field)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')' where? ';' / ';')
union <= 'union' NAME generics? where? '{' (field (',' field)* ','?)? '}'
field <= attr* vis? NAME ':' type
tfield <= attr* vis? type
enum <- 'enum' NAME generics? where? '{' (variant (',' variant)* ','?)? '}'
variant <= attr* vis? NAME ('{' (field (',' field)* ','?)? '}' / '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)?
trait <- 'unsafe'? 'trait' NAME generics? (':' bounds)? where? '{' item* '}'
impl <- 'unsafe'? 'impl' generics? ('const')? '!'? (type 'for')? type where? '{' inner* item* '}'
mod <= 'unsafe'? 'mod' NAME (';' / '{' inner* item* '}')
const <= ('const' / 'static') 'mut'? NAME ':' type ('=' expr)? ';'
typealias <= 'type' NAME generics? (':' bounds)? where? ('=' type)? where? ';'
extern <= 'extern' ('crate' (NAME / 'self') ('as' NAME)? ';' / STR? '{' inner* item* '}')
macro <- path '!' NAME? ('{' tree* '}' / ('(' tree* ')' / '[' tree* ']') ';')
type <- '(' (type (',' type)* ','?)? ')' / '[' type (';' expr)? ']' / ('&' / '&&') LIFE? 'mut'? typenb / '*' ('const' / 'mut') typenb / '!' / '_' / ('dyn' / 'impl') bounds / ('for' generics)? ('unsafe' / 'extern' STR?)* 'fn' '(' (fntype (',' fntype)* ','?)? ')' ('->' typenb)? / typepath ('!' ('(' tree* ')' / '[' tree* ']'))?
typenb <= type
fntype <= (NAME ':')? type / '...'
typepath <- ('<' type ('as' typepath)? '>' '::' / '::')? typeseg ('::' typeseg)*
typeseg <- segment ('::'? typeargs / '(' (type (',' type)* ','?)? ')' ('->' typenb)?)?
typeargs <- '<' (typearg (',' typearg)* ','?)? '>'
typearg <- LIFE / NAME typeargs? ('=' type / ':' bounds) / type / block / PM? NUM / STR / 'true' / 'false'
path <- ('<' type ('as' typepath)? '>' '::' / '::')? pathseg ('::' pathseg)*
pathseg <- segment ('::' typeargs)?
pattern <- ('|' / '||')? pat1 ('|' pat1)*
pat1 <- ('&' / '&&') 'mut'? pat1 / 'ref'? 'mut'? NAME !'::' !'(' !'{' !'!' ('@' pat1)? !rangeop / '..' / '(' (pattern (',' pattern)* ','?)? ')' / '[' (pattern (',' pattern)* ','?)? ']' / patlit (rangeop patlit?)? / rangeop patlit / '_' / 'box' pat1
rangeop <= '..=' / '...' / '..'
patlit <- PM? NUM / STR / 'true' / 'false' / path ('(' (pattern (',' pattern)* ','?)? ')' / '{' (fieldpat (',' fieldpat)* ','?)? '}' / '!' ('(' tree* ')' / '[' tree* ']'))?
fieldpat <= attr* ('..' / (NAME / NUM) ':' pattern / 'ref'? 'mut'? NAME)
block <- '{' inner* stmt* expr? '}'
stmt <- ';' / attr* let / !macroexpr item / blockexpr !'.' !'?' ';'? / attr* expr ';' / macro
macroexpr <= path '!' ('(' / '[')
let <= 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';'
blockexpr <- attr* (LIFE ':')? (if / match / 'loop' block / 'while' cond block / 'for' pattern 'in' exprn block / ('unsafe' / 'async' 'move'? / 'const')? block)
if <- 'if' cond block ('else' (if / block))?
cond <- condterm ('&&' condterm)*
condterm <= 'let' pattern '=' exprc / exprn
match <- 'match' exprn '{' inner* (arm)* '}'
arm <- attr* pattern ('if' cond)? '=>' (blockexpr !'.' !'?' !PM ','? / expr (',' / &'}'))
expr <- range
exprn <- rangen
exprc <- orn_noand
range <- assignee ('=' / ASG / '>' '>=' ) expr / or (rangeop or?)? / rangeop or?
rangen <- orn (('=' / ASG) exprn / rangeop orn?)? / rangeop orn?
assignee <= or
or <- unary ('as' typenb / binop unary)*
orn <- unaryn ('as' typenb / binop unaryn)*
orn_noand <- unaryn ('as' typenb / binopc unaryn)*
binopc <= BIN / PM / '*' / '&' / '<' / '>' '>'? / '>='/ '|'
binop <= BIN / PM / '*' / '&&' / '&' / '||' / '|' / '<' / '>' '>'? / '>='
unary <- (PM / '!' / '*' / ('&' / '&&') ('raw' ('const' / 'mut') / 'mut')?)* postfix
unaryn <- (PM / '!' / '*' / ('&' / '&&') 'mut'?)* postfixn
postfix <- primary trailer*
postfixn <- primaryn trailer*
trailer <= '?' / '.' ('await' / NUM / NAME ('::' typeargs)?) / '(' (expr (',' expr)* ','?)? ')' / '[' expr ']'
primary <- struct_lit / primaryn
primaryn <- NUM / STR / 'true' / 'false' / closure / jump / blockexpr / '(' (expr (',' expr)* ','?)? ')' / '[' (expr (';' expr / (',' expr)* ','?))? ']' / path ('!' ('(' tree* ')' / '[' tree* ']' / '{' tree* '}'))? / '_'
struct_lit <- path '{' (fieldinit (',' fieldinit)* ','?)? ('..' expr?)? '}'
fieldinit <= attr* (NAME / NUM) (':' expr)? / '..' expr?
closure <- 'static'? 'async'? 'move'? ('||' / '|' (closurep (',' closurep)* ','?)? '|') ('->' type block / expr)
closurep <= attr* pat1 (':' type)?
jump <- ('return' / 'break' LIFE? / 'continue' LIFE?) (!';' !'}' !',' !')' expr)?
"""

_SWIFT_KEYWORDS = (
    "associatedtype class deinit enum extension fileprivate func import init inout internal let open operator private protocol public rethrows static struct subscript typealias var break case continue "
    "default defer do else fallthrough for guard if in repeat return switch where while as catch false is nil super self Self throw throws true try await"
)
_SWIFT_OPS = "... ..< === !== &&= ||= <<= >>= &+ &- &* -> == != <= >= && || ?? += -= *= /= %= &= |= ^= << >> + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } @ # \\ $"
_SWIFT_CLASSES = {"ASG": "+= -= *= /= %= &= |= ^= <<= >>=", "BIN": "=== !== == != <= >= && || ?? / % ^ | << >> ... ..< &+ &- &*", "PM": "+ -"}
SWIFT = r"""
program <- stmts EOF
stmts <= (stmt eos)*
eos <= ';' / @eos / &('case' / 'default')
attr <- '@' NAME ('.' NAME)* (@same '(' tree* ')')?
tree <- '(' tree* ')' / '[' tree* ']' / '{' tree* '}' / !')' !']' !'}' !EOF any
any <= ANY
modifier <- attr / ('public' / 'private' / 'fileprivate' / 'internal' / 'open') ('(' NAME ')')? / 'static' / 'class' &(modword / 'func' / 'var' / 'let' / 'subscript') / modword
modword <= ('final' / 'override' / 'mutating' / 'nonmutating' / 'lazy' / 'weak' / 'unowned' / 'required' / 'convenience' / 'dynamic' / 'optional' / 'indirect' / 'async' / 'nonisolated' / 'isolated' / 'prefix' / 'postfix' / 'infix' / 'actor' / 'consuming' / 'borrowing' / 'package' / 'distributed') ('(' NAME ')')? &(WORD / '@')
decl <- modifier* (import / func / init / deinit / typedef / typealias / var / subscript / case / operator / associated)
import <= 'import' ('struct' / 'class' / 'enum' / 'protocol' / 'func' / 'var' / 'let' / 'typealias')? NAME ('.' WORD)*
func <- 'func' (NAME / oper+) generics? params ('async' / 'throws' / 'rethrows' / NAME &'throws')* ('->' type)? where? block?
oper <= BIN / PM / '*' / '<' / '>' / '&' / '!' / '=' / '~' / ASG
init <- 'init' ('?' / '!')? generics? params ('async' / 'throws' / 'rethrows')* where? block?
deinit <= 'deinit' block
subscript <= 'subscript' generics? params '->' type where? accessors?
type <- functype / posttype
type_decl_kind <= 'class' / 'struct' / 'enum' / 'protocol' / 'extension' / 'actor'
typealias <= 'typealias' NAME generics? '=' type where?
associated <= 'associatedtype' NAME (':' type)? ('=' type)? where?
generics <- '<' generic (',' generic)* '>'
generic <= NAME (':' type)?
where <- 'where' requirement (',' requirement)*
requirement <= type (':' type / BIN type)
params <- '(' (param (',' param)*)? ')'
param <- attr* (WORD WORD / WORD) ':' attr* 'inout'? modtype type '...'? BIN? ('=' expr)?
modtype <= (('borrowing' / 'consuming' / 'isolated' / 'sending' / 'some' / 'any') &(NAME / '('))*
body <- '{' (decl eos / ';' / conditional)* '}'
conditional <= '#' ('if' expr / 'elseif' expr / 'else' / 'endif')
case <- 'case' enumcase (',' enumcase)*
enumcase <= NAME ('(' (tupletype (',' tupletype)*)? ')')? ('=' expr)?
operator <= ('prefix' / 'postfix' / 'infix')? 'operator' oper+ (':' NAME)?
var <- ('var' / 'let') binding (',' binding)*
binding <- pattern (':' attr* modtype type)? ('=' expr)? accessors?
accessors <- '{' (modifier* NAME ('(' NAME ')')? ('async' / 'throws')* block? ';'?)+ '}' / block
functype <- attr* '(' (tupletype (',' tupletype)*)? ')' ('async' / 'throws' / 'rethrows')* '->' type
tupletype <- (WORD WORD? ':')? attr* 'inout'? modtype type '...'? BIN? ('=' expr)?
posttype <- attr* (('some' / 'any') &NAME)? primtype (@same ('?' / '!') / @same '.' ('Type' / 'Protocol'))* ('&' posttype)*
primtype <- '[' type (':' type)? ']' / '(' (tupletype (',' tupletype)*)? ')' / (NAME / 'Self') typeargs? ('.' NAME typeargs?)* / 'inout' type / '_'
typeargs <- '<' type (',' type)* '>'
block <- '{' stmts '}'
stmt <- ';' / conditional / decl / if / guard / for / while / repeat / switch / do / jump / 'defer' block / NAME ':' (for / while / repeat / switch / if / do) / expr
typedef <= type_decl_kind NAME ('.' NAME)* generics? (':' inherit (',' inherit)*)? where? body
inherit <= attr* 'class' / attr* ('~')? type
jump <= 'return' (@same !';' !'}' expr)? / 'break' (@same NAME)? / 'continue' (@same NAME)? / 'fallthrough' / 'throw' expr
if <- 'if' conds block ('else' (if / block))?
guard <- 'guard' conds 'else' block
while <= 'while' conds block
repeat <= 'repeat' block 'while' expr
conds <- cond (',' cond)*
cond <- ('let' / 'var') pattern (':' type)? ('=' exprn)? / 'case' pattern (':' type)? '=' exprn / '#' NAME '(' tree* ')' / exprn
for <- 'for' 'try'? 'await'? 'case'? pattern (':' type)? 'in' exprn ('where' exprn)? block
switch <- 'switch' exprn '{' (conditional / attr? ('case' casepat (',' casepat)* / 'default') ':' stmts)* '}'
casepat <= pattern ('where' expr)?
do <- 'do' ('throws' ('(' type ')')?)? block ('catch' (!'{' pattern (',' pattern)*)? ('where' exprn)? block)*
pattern <- patprim (('as' / 'is') type)? '?'? 
patprim <- ('let' / 'var') pattern / 'is' type / '(' (patitem (',' patitem)*)? ')' / ('.' WORD / NAME '.' WORD) ('(' (patitem (',' patitem)*)? ')')? '?'? / NAME !'.' !'(' / '_' / exprn
patitem <= (WORD ':')? pattern
expr <- ('try' ('?' / '!')? / 'await')* assignexpr
exprn <- ('try' ('?' / '!')? / 'await')* binn
assignexpr <- bin (('=' / ASG) expr)?
bin <- unary (tern / binop 'try'? 'await'? unary / cast)*
binn <- unaryn (ternn / binop 'try'? 'await'? unaryn / cast)*
tern <= '?' expr ':' bin
ternn <= '?' exprn ':' binn
cast <= 'is' type / 'as' ('?' / '!')? type
binop <= BIN / PM / '*' / '&' / '<' / '>' / '!' '='
unary <- (PM / '!' / '~' / '&' / BIN &(NUM / NAME))* postfix
unaryn <- (PM / '!' / '~' / '&' / BIN &(NUM / NAME))* postfixn
postfix <- primary trailer* (@same BIN &(')' / ']' / ',' ))?
postfixn <- primary trailern*
trailer <= '.' (WORD / NUM) / @same '(' args? ')' / @same '[' args? ']' / @same '!' !'=' / @same '?' &('.' / '(' / '[' / '?') / typeargs &('(' / '.') / closure (@same NAME ':' closure)*
trailern <= '.' (WORD / NUM) / @same '(' args? ')' / @same '[' args? ']' / @same '!' !'=' / @same '?' &('.' / '(' / '[' / '?') / typeargs &('(' / '.')
args <- arg (',' arg)* ','?
arg <- (WORD ':')? (expr / oper &(',' / ')'))
primary <- NUM / STR / 'true' / 'false' / 'nil' / NAME / 'self' / 'Self' / 'super' / 'init' / '$' NUM / '[' (expr (':' expr (',' expr ':' expr)* / (',' expr)*) ','? / ':')? ']' / '(' (args)? ')' / closure / '.' WORD / '\\' type? ('.' (WORD ('?' / '!')?))+ / '#' WORD ('(' tree* ')')? / 'if' conds block ('else' (if / block)) / switch / '_'
closure <- '{' closuresig? stmts '}'
closuresig <= attr* ('[' capture (',' capture)* ']')? ((NAME (',' NAME)* / params / '(' (NAME (':' type)? (',' NAME (':' type)?)*)? ')') ('async' / 'throws')* ('->' type)?)? 'in'
capture <= NAME? ('(' NAME ')')? (NAME / 'self') ('=' expr)?
"""

_JS_STRING = _DQ + "|" + _SQ


def _js(typed: bool):
    lexer = TemplateLexer(
        skip=_C_SKIP + r"|\A#![^\n]*", name=r"(?:[^\W\d]|\$)[\w$]*", number=_NUM + "n?", string=_JS_STRING + r"|(?P<tpl>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`)", ops=_JS_OPS, keywords=_JS_KEYWORDS, classes=_JS_CLASSES, regex=True
    )
    return lexer, _flavour(_JS, typed)


_PARTS = {
    "python": lambda: (PythonLexer(), PYTHON),
    "javascript": lambda: _js(False),
    "typescript": lambda: _js(True),
    "java": lambda: (Lexer(skip=_C_SKIP, name=r"(?:[^\W\d]|\$)[\w$]*", number=_NUM + "[lLfFdD]?", string=r"\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|" + _DQ + r"|'(?:[^'\\\n]|\\[^\n]\w*)'", ops=_C_OPS, keywords=_JAVA_KEYWORDS, classes=_C_CLASSES), JAVA),
    "csharp": lambda: (Lexer(skip=_C_SKIP + r"|#[ \t]*(?:region|endregion|if|elif|else|endif|define|undef|pragma|nullable|warning|error|line)\b[^\n]*", name="@?" + _NAME, number=_NUM + "[uUlLfFdDmM]*", string=r"\$*\"\"\"+(?:[^\"]|\"(?!\"\"))*\"\"\"+|(?:@|\$@|@\$)\"(?:[^\"]|\"\")*\"|\$?" + _DQ + r"|'(?:[^'\\\n]|\\[^\n]\w*)'", ops=_CS_OPS, keywords=_CS_KEYWORDS, classes=_CS_CLASSES), CSHARP),
    "c": lambda: (Lexer(skip=r"[ \t\r\n\f\v]+|\\\r?\n|//[^\n]*|/\*[\s\S]*?\*/|(?:#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\]|\\[\s\S])*)", name=_NAME, number=_NUM + "[uUlLfF]*", string=r"(?:u8|[uUL])?" + _DQ + r"|[uUL]?'(?:[^'\\\n]|\\[^\n]\w*)+'", ops=_CC_OPS, keywords=_C_KEYWORDS, classes=_CC_CLASSES), C),
    "go": lambda: (Lexer(skip=_C_SKIP, name=_NAME, number=_NUM + "i?", string=r"`[^`]*`|" + _DQ + r"|'(?:[^'\\\n]|\\[^\n]\w*)'", ops=_GO_OPS, keywords=_GO_KEYWORDS, classes=_GO_CLASSES, semicolons=True), GO),
    "rust": lambda: (Lexer(skip=_C_SKIP, name=r"(?![bc]?r?#*\"|b')(?:r#)?" + _NAME, number=r"0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bo][0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?", string=r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[^\n]))'|(?P<life>'[^\W\d]\w*(?!'))", ops=_RUST_OPS, keywords=_RUST_KEYWORDS, classes=_RUST_CLASSES), RUST),
    "swift": lambda: (Lexer(skip=_C_SKIP, name=r"`" + _NAME + "`|" + _NAME, number=_NUM, string=r"(?P<h>#*)\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"(?P=h)|(?P<g>#+)\"(?:[^\"\n]|\"(?!#))*\"(?P=g)|\"(?:[^\"\\\n]|\\\((?:[^()\"\n]|\"[^\"\n]*\"|\([^()\n]*\))*\)|\\[^\n(])*\"", ops=_SWIFT_OPS, keywords=_SWIFT_KEYWORDS, classes=_SWIFT_CLASSES), SWIFT),
}
LANGUAGES = tuple(_PARTS)


class Parser:
    """Lexer and grammar of one language."""

    def __init__(self, language: str):
        self.lexer, source = _PARTS[language]()
        grammar = Grammar(source, frozenset(self.lexer.fixed))
        self.fast, self._slow, self._grammar = Compiled(grammar, False), None, grammar

    @property
    def slow(self) -> Compiled:
        if self._slow is None:
            self._slow = Compiled(self._grammar, True)
        return self._slow


@lru_cache(maxsize=None)
def parser(language: str) -> Parser:
    return Parser(language)
