"""Fixed values of the answer grammar.

FIXED VALUES: the lists below decide which answers count as equal, so they are stated
as they are, in their working order.
"""

# Characters dropped at either end of an answer; the two Cyrillic letters end the
# steps of one family of step-by-step models.
EDGE_CHARS = ":./,#?$\"'ки"
TRAILING_CHARS = "([{\\" + EDGE_CHARS
LEADING_CHARS = "!)]}" + EDGE_CHARS

# Text in front of the final answer.
NARROWING_MARKS = ("herefore", "####", "# Answer")
BEFORE_CUES = ("is the ans", "is our ans")
AFTER_CUES = ("answer is", "answer:", "answer :")

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

NUMBER_WORDS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty",
)

FUNCTION_NAMES = "sin|cos|tan|cot|sec|csc|sinh|cosh|tanh|coth|sech|csch|log|ln|exp"

VARIABLE_NAMES = (
    "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|omicron|pi|rho|"
    "sigma|tau|upsilon|phi|chi|psi|omega|sin|cos|sec|csc|tan|cot|sinh|cosh|sech|csch|tanh|"
    "coth|log|ln|exp"
)

# Unit suffixes; "a.m." and "p.m." are handled after these.
UNITS = (
    "hour", "minute", "min", "sec", "second", "day", "week", "month", "year", "meter",
    "mile", "kg", "mg", "g", "t", "ton", "nm", "pm", "um", "μm", "m", "cm", "mm", "dm",
    "km", "kilometer", "inch", "feet", "piece", "bit", "hz", "Hz", "m/s", "km/s",
    "billion", "eV", "V", "C", "s",
)

REMOVED = (
    "\n", "\t", "approximately", "'", '"', "\\$", "$", "￥", "£", "€", "{,}",
    "\\!", "\\,", "\\:", "\\;", "\\quad", "\\qquad", "\\space", "\\thinspace",
    "\\medspace", "\\thickspace", "~,", "\\ ", "\\\\%", "\\%", "%", "\\left", "\\right",
    "^{\\circ}", "^\\circ",
)

REPLACED = (
    ("∪", "\\cup"), ("π", "\\pi"), ("∞", "\\infty"), ("∈", "\\in"), ("∩", "\\cap"),
    ("−", "-"), ("\\item", ","), ("and", ","), (";", ","), ("infinity", "\\infty"),
    ("+\\infty", "\\infty"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\approx", "="),
    ("\\times", "*"), ("\\cdot", "*"), ("{.", "{0."), (" .", " 0."), (":", "/"),
)

STYLE_COMMANDS = (
    "\\textbf", "\\textit", "\\textsl", "\\texttt", "\\textsc", "\\textsf", "\\textrm",
    "\\mathrm", "\\mathbf", "\\mathit", "\\mathsf", "\\mathtt", "\\mathbb", "\\mathcal",
    "\\mathscr", "\\mathfrak", "\\bm", "\\em", "\\emph", "\\underline", "\\overline",
    "\\tiny", "\\scriptsize", "\\footnotesize", "\\small", "\\normalsize", "\\large",
    "\\Large", "\\LARGE", "\\huge", "\\Huge", "\\newline", "\\par", "\\noindent",
    "\\indent", "\\footnote", "\\cite", "\\ref", "\\label", "\\textsuperscript",
    "\\textsubscript", "\\text", "\\mbox", "\\renewcommand{\\arraystretch}",
)

ENVIRONMENTS = (
    "align", "align*", "center", "flushleft", "flushright", "itemize", "enumerate",
    "description",
)

# Olympiad answers: replaced before comparison, then these characters leave both ends.
OLYMPIAD_REPLACED = (
    ("\\left", ""), ("\\right", ""), ("∶", ":"), ("，", ","), ("$", ""), ("\\approx", "="),
    ("\\simeq", "="), ("\\sim", "="), ("^\\prime", "'"), ("^{\\prime}", "'"),
    ("^\\circ", ""), ("%", ""),
)
OLYMPIAD_EDGE_CHARS = "\n$,.:;^_=+`!@#%&*~，。"
