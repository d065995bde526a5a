"""Grammars of seven languages for the derivative parser.

Operator precedence is left out, since it never decides whether a text is valid. Where two readings
differ only later (a parenthesis or an arrow's parameters) both are followed.
"""

from __future__ import annotations

from functools import cache

from strataforge.llm.derivatives import Grammar, Verdict, recognise
from strataforge.functions.lexing import CONTEXTUAL, KEYWORDS, Lexed

_SCRIPT = """
program = {stmt} .
block = "{" {stmt} "}" .
stmt = block | ";" | vars ";" | func | class | declared
     | "if" "(" expr ")" stmt ["else" stmt]
     | "for" ["await"] "(" forhead ")" stmt
     | "while" "(" expr ")" stmt | "do" stmt "while" "(" expr ")" ";"
     | "return" [expr] ";" | "break" [ID] ";" | "continue" [ID] ";" | "throw" expr ";" | "debugger" ";"
     | "try" block ["catch" ["(" binding tann ")"] block] ["finally" block]
     | "switch" "(" expr ")" "{" {("case" expr | "default") ":" {stmt}} "}"
     | "with" "(" expr ")" stmt
     | ID ":" stmt | import | export | xexpr ";" .
forhead = [forvars | expr] ";" [expr] ";" [expr] | (varword binding | operand) ("of" | "in") expr .
forvars = varword vd {"," vd} .
varword = "var" | "let" | "const" .
vars = ("var" | "let") vd {"," vd} | "const" cd {"," cd} .
vd = binding bang tann ["=" asg] .
cd = binding tann "=" asg .
binding = ID | array | object .
func = ["async"] "function" ["*"] [ID] tparams params tret fbody .
params = "(" [param {"," param} [","]] ")" .
param = {decorator} pmods ["..."] (binding | "this") opt tann ["=" asg] .
class = {decorator} cmods "class" [ID] tparams ["extends" operand] impl cbody .
cbody = "{" {";" | member} "}" .
member = {decorator} {mod} ( key pmark tann ["=" asg] ";" | key pmark tparams params tret mbody ) | "static" block | indexsig .
mod = "static" | "async" | "get" | "set" | "*" | "accessor" | tmod .
key = NAME | STR | NUM | "[" asg "]" .
decorator = "@" (ID {"." NAME} [args] | "(" expr ")") .
import = "import" (STR | clause "from" STR [("with" | "assert") object]) ";" | timport .
clause = ttype (ID ["," (named | star)] | named | star) .
star = "*" "as" ID .
named = "{" [spec {"," spec} [","]] "}" .
spec = ttype (NAME | STR) ["as" (NAME | STR)] .
export = {decorator} "export" ( "default" (func | class | asgx ";" | tdefault) | vars ";" | func | class | declared
     | ttype named ["from" STR] ";" | ttype "*" ["as" NAME] "from" STR ";" | texport ) .
expr = asg {"," asg} .
asg = operand {binop operand} ["?" asg ":" asg] .
xexpr = xasg {"," asg} .
xasg = xoperand {binop operand} ["?" asg ":" asg] .
asgx = xasg | object .
operand = {prefix} postfix | "yield" ["*"] [asg] | arrow .
xoperand = prefix {prefix} postfix | xpostfix | "yield" ["*"] [asg] | arrow .
prefix = "!" | "~" | "+" | "-" | "++" | "--" | "typeof" | "void" | "delete" | "await" | "new" | tcast .
postfix = (primary | object | func | class) {suffix} .
xpostfix = primary {suffix} .
suffix = "." (NAME | "#") | "?." (NAME | "[" expr "]" | args) | "[" expr "]" | args | template | "++" | "--" | tsuffix .
args = "(" [arg {"," arg} [","]] ")" .
arg = ["..."] asg .
primary = ID | "this" | "super" | "null" | "true" | "false" | NUM | STR | REGEX | template | array | "(" expr ")" | "import" (args | "." ID) | "new" "." ID .
template = TPL | TPLH expr {TPLM expr} TPLT .
array = "[" [arg] {"," [arg]} "]" .
object = "{" [prop {"," prop} [","]] "}" .
prop = "..." asg | key ":" asg | ID ["=" asg] | {mod} key tparams params tret fbody .
fbody = block .
arrow = ["async"] (ID | tparams params tret) "=>" (block | asgx | arrow) .
binop = "=" | "==" | "!=" | "===" | "!==" | "<" | "<=" | "<<" | gt | "+" | "-" | "*" | "/" | "%" | "**" | "&" | "|" | "^" | "&&" | "||" | "??"
      | "+=" | "-=" | "*=" | "/=" | "%=" | "**=" | "&=" | "|=" | "^=" | "&&=" | "||=" | "??=" | "<<=" | "in" | "instanceof" .
gt = ">" [">" [">"]] ["="] .
"""
_PLAIN = """
bang = . tann = . tparams = . tret = . pmods = . opt = . cmods = . impl = . pmark = . ttype = .
mbody = block .
never = "NEVER" . indexsig = never . tmod = never . timport = never . declared = never . tdefault = never . texport = never . tcast = never . tsuffix = never .
"""
_TYPED = """
bang = ["!"] .
tann = [":" type] .
tret = [":" type] .
opt = ["?"] .
pmark = ["?" | "!"] .
pmods = {"public" | "private" | "protected" | "readonly" | "override"} .
cmods = ["abstract"] .
impl = ["implements" type {"," type}] .
ttype = ["type"] .
mbody = block | ";" .
tmod = "public" | "private" | "protected" | "readonly" | "abstract" | "override" | "declare" .
indexsig = {tmod | "static"} "[" ID ":" type "]" tann ";" .
tcast = "<" type ">" .
tsuffix = "!" | "<" type {"," type} ">" (args | template) | ("as" | "satisfies") type .
timport = "import" ID "=" asg ";" .
tdefault = "interface" ID tparams ["extends" type {"," type}] tobject .
texport = "=" asg ";" | "as" "namespace" ID ";" | timport .
declared = "interface" ID tparams ["extends" type {"," type}] tobject
    | "type" ID tparams "=" type ";"
    | ["const"] "enum" ID "{" [key ["=" asg] {"," key ["=" asg]} [","]] "}"
    | ("namespace" | "module") (ID {"." NAME} | STR) block
    | "declare" (declared | func0 | class | varword vd {"," vd} ";" | "global" ambient | ("namespace" | "module") (ID {"." NAME} | STR) ambient | "module" STR ";")
    | func0 .
ambient = "{" {stmt | ["export"] varword vd {"," vd} ";"} "}" .
func0 = ["async"] "function" ["*"] ID tparams params tret ";" .
tparams = ["<" tparam {"," tparam} [","] ">"] .
tparam = {"const" | "in"} ID ["extends" type] ["=" type] .
type = tunion ["extends" tunion "?" type ":" type] .
tunion = ["|" | "&"] tprim {("|" | "&") tprim} .
tprim = {"readonly" | "keyof" | "typeof" | "infer" | "unique" | "asserts"} tbase {"[" [type] "]"} ["is" type] .
tbase = (NAME | "import" "(" STR ")") {"." NAME} ["<" type {"," type} ">"] | STR | NUM | "-" NUM | TPL | TPLH type {TPLM type} TPLT | tobject
     | "[" [telem {"," telem} [","]] "]" | "(" type ")" | ["abstract"] ["new"] tparams params "=>" type .
telem = ["..."] [ID ["?"] ":"] type ["?"] .
tobject = "{" {tmember (";" | ",")} [tmember] "}" .
tmember = {"readonly" | "get" | "set" | "static"} ( key ["?"] tann | key ["?"] tparams params tret )
     | ["new"] tparams params tret | [("+" | "-")] ["readonly"] "[" ID (":" | "in") type ["as" type] "]" [("+" | "-")] ["?"] tann .
"""
_PYTHON = """
file = {NEWLINE | stmt} .
stmt = line | compound .
line = simple {";" simple} [";"] NEWLINE .
simple = "pass" | "break" | "continue" | "return" [exprs] | "raise" [test ["from" test]] | ("global" | "nonlocal") ID {"," ID} | "del" exprs
    | "assert" test ["," test] | imports | exprs assign | yield | "type" ID [tparams] "=" test .
assign = [":" test ["=" rhs]] | augmented rhs | "=" rhs {"=" rhs} .
augmented = "+=" | "-=" | "*=" | "/=" | "//=" | "%=" | "**=" | "&=" | "|=" | "^=" | "<<=" | ">>=" | "@=" .
rhs = exprs | yield .
yield = "yield" ["from" test | exprs] .
imports = "import" dotted ["as" ID] {"," dotted ["as" ID]} | "from" ({"." | "..."} dotted | ("." | "...") {"." | "..."}) "import" ("*" | names | "(" names [","] ")") .
dotted = ID {"." ID} .
names = ID ["as" ID] {"," ID ["as" ID]} .
exprs = star {"," star} [","] .
star = ["*"] ntest .
ntest = test [":=" test] .
test = chain ["if" chain "else" test] | lambda .
chain = operand {binop operand} .
operand = {"not" | "-" | "+" | "~" | "await"} atom {trailer} .
binop = "+" | "-" | "*" | "/" | "//" | "%" | "**" | "@" | "&" | "|" | "^" | "<<" | ">>" | "<" | ">" | "<=" | ">=" | "==" | "!=" | "and" | "or" | "in" | "not" "in" | "is" ["not"] .
atom = ID | NUM | STR {STR} | "..." | "None" | "True" | "False" | "(" [yield | items] ")" | "[" [items] "]" | "{" [entries] "}" .
items = star (comp | {"," star} [","]) .
entries = entry (comp | {"," entry} [","]) | star (comp | {"," star} [","]) .
entry = "**" chain | test ":" test .
comp = {["async"] "for" exprs_in "in" ctest {"if" ctest}} .
ctest = chain [":=" chain] | lambda .
exprs_in = tgt {"," tgt} [","] .
tgt = ["*"] tatom {trailer} .
tatom = ID | "(" exprs_in ")" | "[" exprs_in "]" .
trailer = "." ID | "(" [arg {"," arg} [","]] ")" | "[" sub {"," sub} [","] "]" .
arg = "*" test | "**" test | ID "=" test | ntest comp .
sub = star | [test] ":" [test] [":" [test]] .
lambda = "lambda" [lparam {"," lparam} [","]] ":" test .
lparam = "/" | "*" [ID] | "**" ID | ID ["=" test] .
param = "/" | "*" [ID [":" star]] | "**" ID [":" test] | ID [":" test] ["=" test] .
tparams = "[" tparam {"," tparam} [","] "]" .
tparam = ["*" | "**"] ID [":" test] ["=" test] .
block = line | NEWLINE INDENT stmt {stmt} DEDENT .
compound = "if" ntest ":" block {"elif" ntest ":" block} ["else" ":" block]
    | "while" ntest ":" block ["else" ":" block]
    | ["async"] "for" exprs_in "in" exprs ":" block ["else" ":" block]
    | "try" ":" block ({except} ["else" ":" block] ["finally" ":" block])
    | ["async"] "with" (with {"," with} | "(" with {"," with} [","] ")") ":" block
    | {"@" ntest NEWLINE} (["async"] "def" ID [tparams] "(" [param {"," param} [","]] ")" ["->" exprs] ":" block | "class" ID [tparams] ["(" [arg {"," arg} [","]] ")"] ":" block)
    | "match" exprs ":" NEWLINE INDENT "case" patterns ["if" ntest] ":" block {"case" patterns ["if" ntest] ":" block} DEDENT .
except = "except" ["*"] [test {"," test} ["as" ID]] ":" block .
with = test ["as" tgt] .
patterns = pattern {"," pattern} [","] .
pattern = por ["as" ID] .
por = pat {"|" pat} .
pat = ["-"] NUM [("+" | "-") NUM] | STR {STR} | "None" | "True" | "False" | "*" ID | ID {"." ID} ["(" [parg {"," parg} [","]] ")"] | "(" [patterns] ")" | "[" [patterns] "]"
    | "{" [(pat ":" pattern | "**" ID) {"," (pat ":" pattern | "**" ID)} [","]] "}" .
parg = [ID "="] pattern .
"""
_JAVA = """
file = [{ann} "package" qid ";"] {"import" ["static"] ID {"." ID} ["." "*"] ";" | ";"} {typedecl | ";"} .
qid = ID {"." ID} .
ann = "@" qid ["(" [annarg {"," annarg}] ")"] .
annarg = [ID "="] annval .
annval = expr | ann | "{" [annval {"," annval}] [","] "}" .
mod = ann | "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "strictfp" | "default" | "sealed" | "non" "-" "sealed" .
typedecl = {mod} ( "class" ID [tparams] ["extends" type] ["implements" types] ["permits" types] body
    | "interface" ID [tparams] ["extends" types] ["permits" types] body
    | "enum" ID ["implements" types] "{" [constant {"," constant}] [","] [";" {member}] "}"
    | "record" ID [tparams] params ["implements" types] body
    | "@" "interface" ID "{" {member} "}" ) .
constant = {ann} ID [args] [body] .
body = "{" {member} "}" .
member = ";" | ["static"] block | typedecl
    | {mod} ( [tparams] type ID params {"[" "]"} ["throws" types] (block | ["default" annval] ";") | [tparams] ID params ["throws" types] block | type var {"," var} ";" | ID block ) .
tparams = "<" tparam {"," tparam} ">" .
tparam = {ann} ID ["extends" type {"&" type}] .
types = type {"," type} .
prim = "int" | "long" | "double" | "float" | "boolean" | "char" | "byte" | "short" .
type = {ann} (prim | "void" | named) {"[" "]"} .
named = ID [targs] {"." ID [targs]} .
targs = "<" [targ {"," targ}] ">" .
targ = type | {ann} "?" [("extends" | "super") type] .
params = "(" [param {"," param}] ")" .
param = {mod} type ["..."] (ID | "this") {"[" "]"} .
var = ID {"[" "]"} ["=" (expr | arrayinit)] .
arrayinit = "{" [(expr | arrayinit) {"," (expr | arrayinit)}] [","] "}" .
block = "{" {stmt} "}" .
stmt = block | ";" | {mod} type var {"," var} ";" | typedecl | exprstmt ";"
    | "if" "(" expr ")" stmt ["else" stmt] | "while" "(" expr ")" stmt | "do" stmt "while" "(" expr ")" ";"
    | "for" "(" ( [forinit] ";" [expr] ";" [exprstmt {"," exprstmt}] | {mod} type ID ":" expr ) ")" stmt
    | "return" [expr] ";" | "throw" expr ";" | "break" [ID] ";" | "continue" [ID] ";" | "yield" expr ";" | "assert" expr [":" expr] ";"
    | "synchronized" "(" expr ")" block | "switch" "(" expr ")" switchbody | ID ":" stmt
    | "try" ["(" resource {";" resource} [";"] ")"] block {"catch" "(" {mod} type {"|" type} ID ")" block} ["finally" block] .
forinit = {mod} type var {"," var} | exprstmt {"," exprstmt} .
resource = {mod} type ID "=" expr | postfix .
switchbody = "{" {case} "}" .
case = ("case" label {"," label} ["when" expr] | "default") (":" {stmt} | "->" (block | "throw" expr ";" | expr ";")) .
label = expr | type ID | "default" .
exprstmt = ("++" | "--") operand | postfix (assignop expr | "++" | "--") | primary {suffix} args {suffix0} | "new" creator | primary {suffix} "." "new" creator .
suffix0 = "." ID args .
assignop = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" | ">" ">" [">"] "=" .
expr = operand {binop operand | "instanceof" ["final"] type [ID | "(" [pattern {"," pattern}] ")"]} ["?" expr ":" expr] .
pattern = type (ID | "(" [pattern {"," pattern}] ")") .
operand = {"!" | "~" | "+" | "-" | "++" | "--" | "(" type {"&" type} ")"} (postfix | lambda) .
lambda = (ID | "(" [ID {"," ID}] ")" | params) "->" (block | expr) .
binop = assignop | "==" | "!=" | "<" | "<=" | "<<" | ">" [">" [">"]] ["="] | "+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "&&" | "||" .
postfix = primary {suffix} {"++" | "--"} .
primary = ID | NUM | STR | CHR | "true" | "false" | "null" | "this" | "super" | "(" expr ")" | "new" creator | (prim | "void") {"[" "]"} ("." "class" | "::" "new") | "switch" "(" expr ")" switchbody .
suffix = "." ([targs] ID | "this" | "class" | "super" | "new" creator) | "[" expr "]" | "[" "]" | args | [targs] "::" ([targs] ID | "new") .
args = "(" [expr {"," expr}] ")" .
creator = {ann} (prim | named) ( args [body] | "[" expr "]" {"[" [expr] "]"} | "[" "]" {"[" "]"} arrayinit ) .
"""
_GO = """
file = "package" ID ";" {import ";"} {decl ";"} .
import = "import" (ispec | "(" [ispec {";" ispec} [";"]] ")") .
ispec = [ID | "."] STR .
decl = "func" ["(" [plist] ")"] ID [tparams] sig [block] | local .
local = "const" (cspec | "(" [cspec {";" cspec} [";"]] ")") | "var" (vspec | "(" [vspec {";" vspec} [";"]] ")") | "type" (tspec | "(" [tspec {";" tspec} [";"]] ")") .
cspec = ID {"," ID} [[type] "=" exprs] .
vspec = ID {"," ID} (type ["=" exprs] | "=" exprs) .
tspec = ID [tparams] ["="] type .
tparams = "[" ID {"," ID} constraint {"," ID {"," ID} constraint} [","] "]" .
constraint = ["~"] type {"|" ["~"] type} .
type = ID ["." ID] ["[" type {"," type} "]"] | "[" [expr | "..."] "]" type | "*" type | "map" "[" type "]" type | ["<-"] "chan" ["<-"] type | "func" sig
    | "struct" "{" [field {";" field} [";"]] "}" | "interface" "{" [method {";" method} [";"]] "}" | "(" type ")" .
field = ID {"," ID} type [STR] | ["*"] ID ["." ID] ["[" type "]"] [STR] .
method = ID sig | constraint .
sig = "(" [plist] ")" [type | "(" plist ")"] .
plist = pitem {"," pitem} [","] .
pitem = type | ID ["..."] type | "..." type .
block = "{" stmts "}" .
stmts = [stmt] {";" [stmt]} .
stmt = local | ID ":" [stmt] | simple | ("go" | "defer") expr | "return" [exprs] | ("break" | "continue") [ID] | "goto" ID | "fallthrough" | block | if
    | "switch" [[simple] ";"] [simple] "{" {("case" tests | "default") ":" stmts} "}"
    | "select" "{" {("case" simple | "default") ":" stmts} "}"
    | "for" [simple | [simple] ";" [expr] ";" [simple] | [exprs (":=" | "=")] "range" expr] block .
if = "if" [[simple] ";"] simple block ["else" (if | block)] .
tests = (expr | type) {"," (expr | type)} .
simple = exprs [assignop exprs | "++" | "--" | "<-" expr] .
assignop = ":=" | "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" | ">" ">" "=" | "&^=" .
exprs = expr {"," expr} .
expr = operand {binop operand} .
binop = "==" | "!=" | "<" | "<=" | "<<" | ">" [">" | "="] | "+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "&&" | "||" | "&^" .
operand = {"+" | "-" | "!" | "^" | "*" | "&" | "<-"} primary {suffix} .
primary = NUM | STR | CHR | ID | "(" (expr | type) ")" | "func" sig block | lit value | "[" [expr | "..."] "]" type args | "map" "[" type "]" type args | "chan" type args .
lit = "[" [expr | "..."] "]" type | "map" "[" type "]" type | "struct" "{" [field {";" field} [";"]] "}" .
suffix = "." (ID | "(" (type | "type") ")") | "[" index "]" | args | value .
index = (expr | type) {"," (expr | type)} | [expr] ":" [expr] [":" expr] .
args = "(" [arg {"," arg} ["..."] [","]] ")" .
arg = expr | type .
value = "{" [element {"," element} [","]] "}" .
element = [(expr | value) ":"] (expr | value) .
"""
_RUST = """
file = {"#" "!" "[" tts "]"} {item} .
attr = "#" "[" tts "]" .
tts = {tt} .
tt = "(" tts ")" | "[" tts "]" | "{" tts "}" | ANY .
item = {attr} vis kind .
vis = ["pub" ["(" tts ")"]] .
kind = "use" usetree ";" | fn
    | "struct" ID [generics] ([where] ("{" [sfield {"," sfield} [","]] "}" | ";") | "(" [tfield {"," tfield} [","]] ")" [where] ";")
    | "union" ID [generics] [where] "{" [sfield {"," sfield} [","]] "}"
    | "enum" ID [generics] [where] "{" [variant {"," variant} [","]] "}"
    | ["unsafe"] "impl" [generics] ["!"] type ["for" type] [where] "{" {"#" "!" "[" tts "]"} {item} "}"
    | ["unsafe"] ["auto"] "trait" ID [generics] [":" bounds] [where] "{" {item} "}"
    | ["unsafe"] "mod" ID (";" | "{" {"#" "!" "[" tts "]"} {item} "}")
    | ("const" (ID | "_") | "static" ["mut"] ID) ":" type ["=" expr] ";"
    | "type" ID [generics] [":" bounds] [where] ["=" type] ";"
    | ["unsafe"] "extern" ("crate" ID ["as" ID] ";" | [STR] "{" {item} "}")
    | "macro_rules" "!" ID ("{" tts "}" | "(" tts ")" ";")
    | path "!" ("{" tts "}" | "(" tts ")" ";" | "[" tts "]" ";") .
usetree = ["::"] upath .
upath = ("*" | "{" [usetree {"," usetree} [","]] "}" | PATHWORD ["::" upath]) ["as" (ID | "_")] .
fn = {"const" | "async" | "unsafe" | "extern" [STR]} "fn" ID [generics] "(" [fparam {"," fparam} [","]] ")" ["->" type] [where] (block | ";") .
fparam = {attr} (["&" [LIFE]] ["mut"] "self" [":" type] | pattern ":" type) .
sfield = {attr} vis ID ":" type .
tfield = {attr} vis type .
variant = {attr} vis ID ["{" [sfield {"," sfield} [","]] "}" | "(" [tfield {"," tfield} [","]] ")"] ["=" expr] .
generics = "<" [gparam {"," gparam} [","]] ">" .
gparam = {attr} (LIFE [":" bounds] | ID [":" bounds] ["=" type] | "const" ID ":" type ["=" expr]) .
where = "where" [wpred {"," wpred} [","]] .
wpred = LIFE ":" bounds | ["for" generics] type ":" bounds .
type = "&" [LIFE] ["mut"] type | "&&" [LIFE] ["mut"] type | "*" ("const" | "mut") type | "[" type [";" expr] "]" | "(" [type {"," type} [","]] ")" | "!" | "_"
    | ["dyn" | "impl"] bounds | ["for" generics] ["unsafe"] ["extern" [STR]] "fn" "(" [[(ID | "_") ":"] type {"," [(ID | "_") ":"] type} [","]] ")" ["->" type] .
bounds = [bound {"+" bound}] .
bound = ["?"] (LIFE | ["for" generics] tpath | "(" bound ")") .
tpath = ["::"] tseg {"::" tseg} | "<" type ["as" tpath] ">" {"::" tseg} .
tseg = PATHWORD ["<" [garg {"," garg} [","]] ">" | "::" "<" [garg {"," garg} [","]] ">" | "(" [type {"," type} [","]] ")" ["->" type]] .
garg = LIFE | type | ID "=" type | ID ":" bounds | ["-"] NUM | STR | CHR | "true" | "false" | block .
path = ["::"] seg {"::" seg} | "<" type ["as" tpath] ">" "::" seg {"::" seg} .
seg = PATHWORD | "<" [garg {"," garg} [","]] ">" .
block = "{" {"#" "!" "[" tts "]"} {stmt} [{attr} expr] "}" .
stmt = ";" | item | {attr} "let" pattern [":" type] ["=" expr ["else" block]] ";" | {attr} blocky | {attr} expr ";" .
blocky = [LIFE ":"] (block | "unsafe" block | "async" ["move"] block | "const" block | "loop" block | "while" cond block | "for" pattern "in" expr block) | if | match .
if = "if" cond block ["else" (if | block)] .
cond = clause {"&&" clause} .
clause = expr | "let" pattern "=" expr .
match = "match" expr "{" {{attr} pattern ["if" cond] "=>" (expr "," | blocky [","])} [{attr} pattern ["if" cond] "=>" expr] "}" .
expr = range {binop range} .
range = operand [(".." | "..=") [operand]] | (".." | "..=") [operand] .
operand = {"-" | "!" | "*" | "&" ["mut"] | "&&" ["mut"]} postfix {"as" type} .
postfix = primary {suffix} .
suffix = "." (PATHWORD ["::" "<" [garg {"," garg} [","]] ">"] | NUM | "await") | "?" | "(" [expr {"," expr} [","]] ")" | "[" expr "]" .
primary = NUM | STR | CHR | "true" | "false" | "_" | path | path "!" ("(" tts ")" | "[" tts "]" | "{" tts "}") | path "{" [init {"," init} [","]] [".." [expr]] "}"
    | "(" [expr {"," expr} [","]] ")" | "[" [expr ({"," expr} [","] | ";" expr)] "]" | blocky
    | "return" [expr] | "break" [LIFE] [expr] | "continue" [LIFE]
    | ["static"] ["async"] ["move"] ("||" | "|" [cparam {"," cparam} [","]] "|") (expr | "->" type block) .
cparam = {attr} pat [":" type] .
init = {attr} (ID | NUM) [":" expr] .
binop = "=" | "==" | "!=" | "<" | "<=" | "<<" | ">" [">"] ["="] | "+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "&&" | "||" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" .
pattern = ["|"] pat {"|" pat} .
pat = "_" | ".." | plit [("..=" | ".." | "...") [plit]] | "..=" plit | ["ref"] ["mut"] ID ["@" pat] | path ["(" [pattern {"," pattern} [","]] ")" | "{" [pfield {"," pfield} [","]] "}"]
    | "&" ["mut"] pat | "&&" ["mut"] pat | "(" [pattern {"," pattern} [","]] ")" | "[" [pattern {"," pattern} [","]] "]" | path "!" "(" tts ")" | "const" block .
plit = ["-"] NUM | STR | CHR | "true" | "false" | path .
pfield = {attr} (["ref"] ["mut"] ID | (ID | NUM) ":" pattern | "..") .
"""
_CSHARP = """
file = {"extern" ID ID ";"} {using} {"[" attrs "]"} {stmt} {entity} .
using = ["global"] "using" ["static"] [ID "="] type ";" .
entity = namespace | typedecl .
namespace = "namespace" ID {"." ID} (";" {using} | "{" {using} {entity} "}" [";"]) .
attrs = [(ID | "return" | "event") ":"] attrib {"," attrib} [","] .
attrib = ID {("." | "::") ID} [targs] [args] .
mod = "public" | "private" | "protected" | "internal" | "static" | "readonly" | "sealed" | "abstract" | "virtual" | "override" | "new" | "async" | "extern" | "unsafe" | "volatile" | "partial" | "const" | "ref" | "required" | "file" | "fixed" .
typedecl = {"[" attrs "]"} {mod} ( ("class" | "struct" | "interface" | "record" ["struct" | "class"]) ID [tparams] [params] [":" base {"," base}] {where} ("{" {member} "}" [";"] | ";")
    | "enum" ID [":" type] "{" [{"[" attrs "]"} ID ["=" expr] {"," {"[" attrs "]"} ID ["=" expr]} [","]] "}" [";"]
    | "delegate" type ID [tparams] params {where} ";" ) .
base = type [args] .
tparams = "<" {"[" attrs "]"} ["in" | "out"] ID {"," ["in" | "out"] ID} ">" .
where = "where" ID ":" bound {"," bound} .
bound = type | "class" ["?"] | "struct" | "new" "(" ")" | "default" .
member = typedecl | {"[" attrs "]"} {mod} ( type mname [tparams] params {where} fbody | ID params [":" ("base" | "this") args] fbody | "~" ID "(" ")" fbody
    | type var {"," var} ";" | "event" type (var {"," var} ";" | mname accessors) | type mname (accessors ["=" expr ";"] | "=>" expr ";")
    | type [mname0 "."] "this" "[" [param {"," param}] "]" (accessors | "=>" expr ";") | ("implicit" | "explicit") "operator" type params fbody | type "operator" ANYOP params fbody ) .
mname = ID [targs] {"." ID [targs]} .
mname0 = ID [targs] .
fbody = block | "=>" expr ";" | ";" .
accessors = "{" {"[" attrs "]"} {mod} accessor {{"[" attrs "]"} {mod} accessor} "}" .
accessor = ("get" | "set" | "init" | "add" | "remove") (";" | block | "=>" expr ";") .
params = "(" [param {"," param}] ")" .
param = {"[" attrs "]"} {"this" | "ref" | "out" | "in" | "params" | "readonly" | "scoped"} type ID ["=" expr] .
var = ID ["=" (expr | init)] .
builtin = "int" | "long" | "double" | "float" | "bool" | "char" | "byte" | "short" | "decimal" | "string" | "object" | "uint" | "ulong" | "ushort" | "sbyte" | "void" .
type = ["ref" ["readonly"]] (builtin | ID [targs] {("." | "::") ID [targs]} | "(" type [ID] "," type [ID] {"," type [ID]} ")") {"?" | "*" | "[" {","} "]"} .
targs = "<" [type {"," type} | "," {","}] ">" .
block = "{" {stmt} "}" .
stmt = block | ";" | ["const"] ["ref"] ["scoped"] type var {"," var} ";" | exprstmt ";" | {"static" | "async" | "unsafe"} type ID [tparams] params {where} fbody
    | "if" "(" expr ")" stmt ["else" stmt] | "while" "(" expr ")" stmt | "do" stmt "while" "(" expr ")" ";"
    | "for" "(" [type var {"," var} | exprstmt {"," exprstmt}] ";" [expr] ";" [exprstmt {"," exprstmt}] ")" stmt
    | ["await"] "foreach" "(" (type ID | "var" "(" ID {"," ID} ")" | expr) "in" expr ")" stmt
    | "return" ["ref"] [expr] ";" | "throw" [expr] ";" | "break" ";" | "continue" ";" | "goto" (ID | "case" expr | "default") ";" | "yield" ("return" expr | "break") ";"
    | ["await"] "using" ("(" (type var {"," var} | expr) ")" stmt | type var {"," var} ";") | ("lock" | "fixed") "(" (expr | type var) ")" stmt | ("checked" | "unchecked" | "unsafe") block
    | "switch" "(" expr ")" "{" {("case" pattern ["when" expr] | "default") ":" {stmt}} "}" | ID ":" stmt
    | "try" block {"catch" ["(" type [ID] ")"] ["when" "(" expr ")"] block} ["finally" block] .
exprstmt = ("++" | "--") operand | operand (assignop expr | "++" | "--") | "await" operand | primary {suffix} args {suffix0} | primary {suffix} "?." ID args | "new" creator {suffix} | "(" "var"? .
suffix0 = ("." | "?.") ID [targs] args | "!" .
expr = operand {binop operand | "is" pattern | "as" type | "switch" "{" [arm {"," arm} [","]] "}" | "with" init} ["?" expr ":" expr] .
arm = pattern ["when" expr] "=>" expr .
pattern = ["not"] patom {("and" | "or") ["not"] patom} .
patom = expr0 | type [ID] | ("<" ["="] | "<=" | ">" ["="]) expr0 | "var" ID | [type] ["(" [subpat {"," subpat}] ")"] "{" [subpat {"," subpat} [","]] "}" [ID] | "(" [subpat {"," subpat}] ")" [ID] | "[" [pattern {"," pattern}] "]" | ".." | "_" .
subpat = [ID {"." ID} ":"] pattern .
expr0 = {"-" | "+" | "~"} postfix .
operand = {"!" | "~" | "+" | "-" | "++" | "--" | "await" | "&" | "*" | "^" | ".." | "throw" | "ref" | "(" type ")"} (postfix | lambda) .
lambda = {"static" | "async"} (ID | "(" [ID {"," ID}] ")" | params) "=>" (block | expr) | ["async"] "delegate" [params] block .
assignop = "=" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" | "??=" | ">" ">" "=" .
binop = assignop | "==" | "!=" | "<" | "<=" | "<<" | ">" [">" [">"]] ["="] | "+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "&&" | "||" | "??" | ".." .
postfix = primary {suffix} .
primary = ID | builtin | NUM | STR | CHR | "true" | "false" | "null" | "this" | "base" | "(" arg {"," arg} ")" | "new" creator | ("typeof" | "sizeof" | "default" | "checked" | "unchecked") "(" (type | expr) ")" | "default"
    | "stackalloc" type "[" expr "]" | "[" [arg {"," arg} [","]] "]" .
suffix = ("." | "?." | "->" | "::") ID [targs] | "[" arg {"," arg} "]" | "?" "[" arg {"," arg} "]" | args | "!" | "++" | "--" | targs args .
args = "(" [arg {"," arg}] ")" .
arg = [ID ":"] (["ref" | "in"] expr | "out" (expr | type ID) | ".." [expr]) .
creator = [ctype] args [init] | ctype ("[" expr {"," expr} "]" {"[" {","} "]"} [init] | "[" {","} "]" {"[" {","} "]"} init | init) | "[" {","} "]" init | init .
ctype = builtin | ID [targs] {("." | "::") ID [targs]} ["?"] .
init = "{" [(expr | init | "[" expr "]" "=" expr | ID "=" init) {"," (expr | init | "[" expr "]" "=" expr | ID "=" init)} [","]] "}" .
""".replace(' | "(" "var"? .', " .")

_ROOT = {"javascript": "program", "typescript": "program"}
_TEXT = {"javascript": _SCRIPT + _PLAIN, "typescript": _SCRIPT + _TYPED, "python": _PYTHON, "java": _JAVA, "go": _GO, "rust": _RUST, "csharp": _CSHARP}
_OPERATORS = "== != <= << <<= && || ++ -- += -= *= /= %= &= |= ^= ; , < > . ? : = + - * / % & | ^ ! ~ @ # $ => -> :: ..= ... .."


@cache
def grammar(language: str) -> Grammar:
    """The grammar of one language; its table of derivatives grows over all files of this process."""
    soft = frozenset(CONTEXTUAL[language].split())
    every = KEYWORDS[language]
    classes = {"ID": frozenset(["ID"]) | soft, "NAME": frozenset(["ID"]) | every}
    if language == "rust":
        classes["PATHWORD"] = frozenset(["ID", "self", "Self", "super", "crate"]) | soft
        classes["ANY"] = every | frozenset(_OPERATORS.split()) | frozenset(["ID", "NUM", "STR", "CHR", "LIFE"])
        classes["ID"] = classes["ID"] | {"_"}
    if language == "csharp":
        classes["ANYOP"] = frozenset("+ - * / % & | ^ ! ~ ++ -- == != < <= > << true false".split())
    if language == "go":
        classes["ID"] = classes["ID"] | {"_"}
    return Grammar(_TEXT[language], _ROOT.get(language, "file"), classes)


def check(language: str, lexed: Lexed) -> Verdict:
    """Whether the tokens form a valid text. Text without tokens is valid."""
    if not lexed.syms:
        return Verdict()
    script = language in ("javascript", "typescript")
    return recognise(grammar(language), lexed.syms, ";" if script else None, lexed.breaks)
