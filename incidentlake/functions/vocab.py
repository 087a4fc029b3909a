"""Word lists, patterns, label sets and message texts.

These have to keep exactly this wording, because labels, features and prompts
are compared value by value.
"""

# --- operator categories: (military words, private words) per preset ----------
OPERATOR_WORDS = {
    "full": (
        ("military", "air force", "army", "navy", "royal", "raf",
         "usaf", "usmc", "luftwaffe", "fuerza aerea", "armée"),
        ("private", "personal", "executive", "charter"),
    ),
    "short": (
        ("military",),
        ("private", "charter"),
    ),
}

# --- aircraft families, matched on the lower-cased aircraft type --------------
AIRCRAFT_PATTERNS = {
    "is_small_piston":
        r"cessna|piper|beechcraft|beech|mooney|cirrus|diamond|grumman"
        r"|socata|robin|jodel|zenith|kitfox|ultralight",
    "is_helicopter":
        r"helicopter|sikorsky|bell \d|eurocopter|agusta|robinson r"
        r"|r-22|r-44|r-66|md 500|hughes 500|enstrom|schweizer",
    "is_commercial_jet":
        r"boeing|airbus|mcdonnell douglas|dc-\d|b-7\d\d|a3\d\d"
        r"|fokker|bac|vickers|caravelle|comet|concorde|tristar"
        r"|ilyushin|tupolev|antonov",
    "is_turboprop":
        r"atr |atr-|dash 8|dhc-\d|saab 340|saab 2000|let 4"
        r"|embraer 1\d\d|beech 1900|shorts 3|bandeirante",
}

# --- report phrases, matched on the lower-cased summary -----------------------
SUMMARY_PATTERNS = {
    "kw_no_survivors":
        r"no survivors?|none (?:of .{0,25})?survived"
        r"|there were no survivors|no one survived",
    "kw_survived":
        r"surviv|rescued|walked away|escaped|pulled from",
    "kw_all_killed":
        r"all \d+ (?:persons?|people|occupants?|passengers?|crew|aboard)?"
        r" ?(?:were )?(?:killed|died|perished)"
        r"|killing all|killed all"
        r"|all aboard (?:were )?(?:killed|died|perished)"
        r"|both .{0,20}(?:killed|died|perished)"
        r"|all .{0,20} perished",
    "kw_engine":
        r"engine failure|engine fire|loss of power|powerplant"
        r"|engine stall|fuel exhaustion|fuel starvation",
    "kw_fire":
        r"\bfire\b|flame|smoke|burning|inflight fire",
    "kw_weather":
        r"weather|fog|icing|snow|storm|turbulence"
        r"|wind shear|low visibility|thunderstorm",
    "kw_terrain":
        r"terrain|mountain|hillside|cfit|controlled flight"
        r"|struck.*ground|struck.*tree|wire strike",
    "kw_structural":
        r"structural failure|wing.*separat|tail.*separat"
        r"|broke apart|in.?flight break|disintegrat",
    "kw_no_fatalities":
        r"no fatalities|no deaths?|no one (?:was )?killed"
        r"|no casualties|without fatality|no loss of life",
    "kw_injuries_only":
        r"minor injur|serious injur|hospitali[zs]|non.fatal"
        r"|sustained injur|several injur",
    "kw_aircraft_destroyed":
        r"aircraft destroyed|written off|total loss|destroyed on impact",
}

# --- words without which the regex part of a phrase cannot match ---------------
PHRASE_NEEDS = {
    "kw_no_survivors": ("surviv",),
    "kw_all_killed": ("killed", "killing", "died", "perished"),
    "kw_fire": ("fire",),
    "kw_terrain": ("struck",),
    "kw_structural": ("separat", "flight break"),
    "kw_no_fatalities": ("no fatalities", "no death", "no one ", "no casualties", "without fatality", "no loss of life"),
    "kw_injuries_only": ("hospitali", "fatal"),
}

# --- weights of the phrases in the death signal, floor 0 ----------------------
DEATH_SIGNAL_WEIGHTS = {
    "kw_no_survivors": 3, "kw_all_killed": 3, "kw_structural": 2,
    "kw_fire": 1, "kw_terrain": 1, "kw_survived": -2,
}

# --- values of the extracted fields -------------------------------------------
CAUSES = ("Mechanical", "Weather", "Human Error", "Structural", "Fire", "Navigation", "Unknown")
PHASES = ("Takeoff", "Cruise", "Landing", "Ground", "Approach", "Climb", "Descent", "Unknown")
CAUSE_ALIASES = {
    "Mechanical Failure": "Mechanical",
    "Pilot Error": "Human Error",
    "Crew Error": "Human Error",
    "Structural Failure": "Structural",
    "Terrorism": "Unknown",
    "Sabotage": "Unknown",
}

# --- one-hot features in model order ------------------------------------------
CAUSE_FEATURES = ("Mechanical", "Weather", "Human Error", "Structural", "Fire", "Navigation")
PHASE_FEATURES = ("Takeoff", "Cruise", "Landing", "Approach", "Climb", "Descent", "Ground")

# --- the 46 model features in model order -------------------------------------
MODEL_FEATURES = (
    "year", "aboard", "log_aboard", "ground", "ground_flag", "cluster_id", "decade",
    "month", "has_route", "is_military", "is_private", "has_summary", "aircraft_era",
    "aboard_severity_bin", "is_solo", "is_small_piston", "is_helicopter",
    "is_commercial_jet", "is_turboprop", "cause_mechanical", "cause_weather",
    "cause_human_error", "cause_structural", "cause_fire", "cause_navigation",
    "phase_takeoff", "phase_cruise", "phase_landing", "phase_approach", "phase_climb",
    "phase_descent", "phase_ground", "kw_no_survivors", "kw_survived", "kw_all_killed",
    "kw_engine", "kw_fire", "kw_weather", "kw_terrain", "kw_structural",
    "kw_no_fatalities", "kw_injuries_only", "kw_aircraft_destroyed",
    "death_signal_score", "has_cause_extracted", "has_phase_extracted",
)

# --- common English words left out of the text features (a parameter) ---------
STOP_WORDS = tuple("""
me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what
which who whom this that these those am is are was were be been being have has had
having do does did doing an the and but if or because as until while of at by for
with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too
very can will just don should now cannot could ought would
""".split())

# --- words that place a report in a phase, for the offline extractor ----------
PHASE_PATTERNS = {
    "Takeoff": r"\btake.?off\b|\btaking off\b",
    "Landing": r"\blanding\b|\btouchdown\b",
    "Approach": r"\bapproach",
    "Climb": r"\bclimb",
    "Descent": r"\bdescen[dt]",
    "Cruise": r"\bcruis|\ben route\b",
    "Ground": r"\btaxi|\bparked\b",
}

# --- words without which the phase pattern cannot match -------------------------
PHASE_NEEDS = {
    "Takeoff": ("off",),
    "Landing": ("landing", "touchdown"),
    "Approach": ("approach",),
    "Climb": ("climb",),
    "Descent": ("descen",),
    "Cruise": ("cruis", "en route"),
    "Ground": ("taxi", "parked"),
}

# --- cause by report phrase, first match wins, for the offline extractor ------
CAUSE_BY_PHRASE = {
    "kw_structural": "Structural",
    "kw_engine": "Mechanical",
    "kw_fire": "Fire",
    "kw_weather": "Weather",
    "kw_terrain": "Navigation",
}

# --- texts shown when a cluster has no summary yet ----------------------------
NO_SUMMARY_YET = "LLM summary not yet generated."
NO_RECOMMENDATIONS_YET = "No recommendations yet."
NO_TEXT_SUMMARY = "Cluster {label} contains incidents without sufficient summary text for LLM analysis."
NO_TEXT_RECOMMENDATION = "Collect more incident documentation for this cluster."

# --- prompt texts; {name} marks a filled place --------------------------------
EXTRACTION_PROMPT = """\
You are an aviation safety analyst. Extract structured data from the incident report below.
You MUST respond with ONLY a valid JSON object. No explanation. No markdown. No code blocks.
Start your response with { and end with }.

Required JSON structure:
{
  "cause_category": "Mechanical|Weather|Human Error|Structural|Fire|Navigation|Unknown",
  "phase_of_flight": "Takeoff|Cruise|Landing|Ground|Approach|Climb|Descent|Unknown",
  "contributing_factors": ["factor1", "factor2", "factor3"],
  "is_mechanical_failure": true,
  "is_weather_related": false,
  "is_human_error": false
}

INCIDENT REPORT:
{summary}

JSON response:"""

CLUSTER_PROMPT = """\
You are a senior aviation safety engineer conducting a failure pattern analysis.
You MUST respond with ONLY a valid JSON object. No explanation. No markdown. No code blocks.
Start your response with { and end with }.

CLUSTER PROFILE ({count} incidents, {year_start}-{year_end}):
- Dominant severity: {severity}
- Average fatality rate: {fatality_rate}
- Common operators: {operators}
- Common aircraft types: {aircraft}

REPRESENTATIVE INCIDENT SUMMARIES:
{summaries}

Required JSON structure:
{
  "root_cause_summary": "2-3 technical sentences identifying the primary failure pattern",
  "key_contributing_factors": ["factor1", "factor2", "factor3", "factor4"],
  "recommendations": "2-3 specific actionable safety recommendations"
}

JSON response:"""

# --- lengths of the texts placed in prompts and lists -------------------------
EXTRACTION_CHARS = 800
SAMPLE_CHARS = 350
SAMPLES_PER_CLUSTER = 12
NAME_LIST_CHARS = 150
INCIDENT_FACTORS = 5
CLUSTER_FACTORS = 6
