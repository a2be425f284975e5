"""Word lists that results depend on, in natural order."""

# --- transcript features ---
NUMERALS = ["zero", "one", "two", "three", "tree", "four", "five", "six", "seven", "eight", "nine", "niner"]
PHONETIC = [
    "alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "juliett", "kilo", "lima", "mike", "november",
    "oscar", "papa", "quebec", "romeo", "sierra", "tango", "uniform", "victor", "whiskey", "xray", "yankee", "zulu",
]
OPERATORS = [
    "swissair", "lufthansa", "alitalia", "luxair", "csa", "shamrock", "speedbird", "klm", "airfrance", "britishairways", "twinstar", "hansa",
    "sabena", "belair", "crossair",
]
VERBS = [
    "climb", "descend", "maintain", "contact", "cleared", "turn", "hold", "report", "proceed", "expect", "squawk", "standby", "identified",
    "resume", "established", "cross", "taxi", "depart", "land",
]

# --- spans ---
LABELS = ["CALLSIGN", "RUNWAY", "ALTITUDE", "HEADING", "FREQUENCY", "SQUAWK", "COMMAND", "WAYPOINT", "FACILITY"]
DIGITS = ["zero", "one", "two", "three", "tree", "four", "five", "fife", "six", "seven", "eight", "nine", "niner", "triple", "double"]
NUMBERS = [*DIGITS, "hundred", "thousand"]
SPELLING = ["alpha", "alfa", *PHONETIC[1:]]
PLACES = [
    "radar", "tower", "approach", "control", "ground", "information", "apron", "zurich", "rhein", "milan", "geneva", "praha", "bratislava", "ruzyne",
]
GREETINGS = [
    "good afternoon", "good morning", "good evening", "good day", "good night", "good bye", "goodbye", "bye bye", "bye", "hello", "guten tag",
    "tschuss", "servus", "bonjour", "adios", "adieu", "ciao", "thank you", "thanks", "roger", "okay", "ok", "ah", "uh", "oh", "yes", "sir",
]
ALTITUDE_UNITS = ["level", "feet", "foot", "thousand", "hundred", "altitude", "metres", "meters"]
PROCEDURES = ["ils", "localizer", "approach", "runway", "glideslope", "departure", "arrival"]
NOT_CALLSIGN_START = ["and", "roger", "ok", "okay", "hello", "oh", "yes", "request", "radar"]
NOT_ALTITUDE_START = ["climb", "descend", "maintain", "climbing", "descending", "to", "at", "on"]
COMMAND_PHRASES = [
    "cleared for takeoff", "cleared to land", "cleared for landing", "set course", "continue down", "line up", "stand by", "turn left", "turn right",
    "proceed direct", "cleared for ils approach", "cleared ils approach", "cleared touch and go", "continue approach", "continue climb", "stop climb",
    "stop descent", "right turn", "left turn", "reduce speed", "speed up", "lining up", "line up and wait",
]
EXTRA_VERBS = ["continue", "direct", "fly", "confirm", "wait", "call"]

# --- spoken digits ---
SPOKEN = {"0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", ".": "decimal", "-": "dash"}
