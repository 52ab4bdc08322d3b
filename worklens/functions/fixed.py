"""Fixed values.

Word lists, lookup tables, patterns and constants that decide results. They
are facts of the matching rules, so they are stated once, as plain text, and
every operator reads them from here.
"""

# --- fixed values: places -------------------------------------------------

#: (written form, city), in matching order.
CITY_SYNONYMS = [
    ("pune", "Pune"),
    ("poonaw", "Pune"),
    ("bengaluru", "Bengaluru"),
    ("bangalore", "Bengaluru"),
    ("blr", "Bengaluru"),
    ("hyderabad", "Hyderabad"),
    ("secunderabad", "Hyderabad"),
    ("hyd", "Hyderabad"),
    ("mumbai", "Mumbai"),
    ("bombay", "Mumbai"),
    ("chennai", "Chennai"),
    ("madras", "Chennai"),
    ("kolkata", "Kolkata"),
    ("calcutta", "Kolkata"),
    ("delhi", "Delhi"),
    ("new delhi", "Delhi"),
    ("delhi ncr", "Delhi"),
    ("ncr", "Delhi"),
    ("gurgaon", "Gurugram"),
    ("gurugram", "Gurugram"),
    ("noida", "Noida"),
    ("ghaziabad", "Ghaziabad"),
    ("faridabad", "Faridabad"),
    ("kochi", "Kochi"),
    ("cochin", "Kochi"),
    ("thiruvananthapuram", "Thiruvananthapuram"),
    ("trivandrum", "Thiruvananthapuram"),
    ("mysuru", "Mysuru"),
    ("mysore", "Mysuru"),
    ("visakhapatnam", "Visakhapatnam"),
    ("vizag", "Visakhapatnam"),
    ("vijayawada", "Vijayawada"),
    ("jaipur", "Jaipur"),
    ("udaipur", "Udaipur"),
    ("jodhpur", "Jodhpur"),
    ("lucknow", "Lucknow"),
    ("kanpur", "Kanpur"),
    ("agra", "Agra"),
    ("ahmedabad", "Ahmedabad"),
    ("surat", "Surat"),
    ("vadodara", "Vadodara"),
    ("baroda", "Vadodara"),
    ("indore", "Indore"),
    ("bhopal", "Bhopal"),
    ("nagpur", "Nagpur"),
    ("nashik", "Nashik"),
    ("chandigarh", "Chandigarh"),
    ("amritsar", "Amritsar"),
    ("ludhiana", "Ludhiana"),
    ("dehradun", "Dehradun"),
    ("shimla", "Shimla"),
    ("srinagar", "Srinagar"),
    ("jammu", "Jammu"),
    ("goa", "Goa"),
    ("panaji", "Panaji"),
    ("patna", "Patna"),
    ("ranchi", "Ranchi"),
    ("jamshedpur", "Jamshedpur"),
    ("bhubaneswar", "Bhubaneswar"),
    ("guwahati", "Guwahati"),
    ("siliguri", "Siliguri"),
    ("raipur", "Raipur"),
    ("coimbatore", "Coimbatore"),
    ("madurai", "Madurai"),
    ("salem", "Salem"),
    ("trichy", "Trichy"),
    ("tiruchirappalli", "Trichy"),
    ("mangaluru", "Mangaluru"),
    ("mangalore", "Mangaluru"),
    ("kozhikode", "Kozhikode"),
    ("calicut", "Kozhikode"),
    ("remote", "Remote"),
    ("work from home", "Remote"),
    ("work-from-home", "Remote"),
    ("wfh", "Remote"),
    ("anywhere", "Remote"),
    ("telecommute", "Remote"),
    ("virtual", "Remote"),
    ("india", "India"),
    ("pan india", "India"),
    ("pan-india", "India"),
    ("all india", "India"),
    ("anywhere in india", "India"),
]

#: Places that only count when no real city is named.
GENERIC_PLACES = ["India", "Remote"]

#: Written forms not trusted outside a location field.
FREE_TEXT_EXCLUDED = ["ncr", "salem", "virtual"]

#: (region, cities), in lookup order (the first region holding a city wins).
REGION_CITIES = [
    ("Maharashtra", ["pune", "mumbai", "nashik", "nagpur", "aurangabad", "kolhapur", "solapur", "navi mumbai", "thane"]),
    ("Karnataka", ["bengaluru", "bangalore", "mysuru", "mysore", "hubli", "dharwad", "mangaluru", "mangalore", "belgaum", "hubballi"]),
    ("Telangana", ["hyderabad", "secunderabad"]),
    ("Tamil Nadu", ["chennai", "coimbatore", "madurai", "salem", "trichy", "vellore", "erode", "tirupur"]),
    ("Kerala", ["kochi", "cochin", "thiruvananthapuram", "trivandrum", "kozhikode", "calicut"]),
    ("West Bengal", ["kolkata", "siliguri"]),
    ("Delhi NCR", ["delhi", "new delhi", "gurgaon", "gurugram", "noida", "ghaziabad", "faridabad"]),
    ("Gujarat", ["ahmedabad", "surat", "vadodara", "baroda", "rajkot"]),
    ("Rajasthan", ["jaipur", "udaipur", "jodhpur"]),
    ("Uttar Pradesh", ["noida", "lucknow", "kanpur", "agra", "varanasi"]),
    ("Madhya Pradesh", ["indore", "bhopal", "jabalpur", "gwalior"]),
    ("Punjab", ["amritsar", "ludhiana", "jalandhar"]),
    ("Chandigarh", ["chandigarh", "mohali", "panchkula"]),
    ("Bihar", ["patna"]),
    ("Odisha", ["bhubaneswar", "cuttack"]),
    ("Jharkhand", ["ranchi", "jamshedpur"]),
    ("Assam", ["guwahati"]),
    ("Uttarakhand", ["dehradun"]),
    ("Himachal Pradesh", ["shimla"]),
    ("Jammu & Kashmir", ["srinagar", "jammu"]),
    ("Andhra Pradesh", ["visakhapatnam", "vijayawada", "guntur", "nellore", "kakinada"]),
    ("Goa", ["goa", "panaji"]),
    ("Chhattisgarh", ["raipur"]),
    ("Remote", ["remote", "anywhere", "wfh", "work from home", "telecommute"]),
]

#: City spellings used in portal URL slugs.
CITY_SLUGS = [
    "bengaluru", "bangalore", "hyderabad", "secunderabad", "pune", "mumbai", "navi-mumbai", "thane", "kolkata", "chennai", "delhi", "new-delhi",
    "gurgaon", "gurugram", "noida", "ghaziabad", "faridabad", "ahmedabad", "surat", "vadodara", "jaipur", "udaipur", "jodhpur", "lucknow", "kanpur",
    "agra", "varanasi", "prayagraj", "allahabad", "indore", "bhopal", "jabalpur", "gwalior", "nagpur", "nashik", "aurangabad", "kolhapur", "solapur",
    "sangli", "rajkot", "bhavnagar", "jamnagar", "kochi", "cochin", "trivandrum", "thiruvananthapuram", "kozhikode", "calicut", "mangalore",
    "mangaluru", "mysore", "mysuru", "hubli", "dharwad", "belgaum", "coimbatore", "madurai", "salem", "trichy", "tiruchirappalli", "vellore",
    "tirupur", "erode", "vijayawada", "visakhapatnam", "vizag", "nellore", "kakinada", "guntur", "raipur", "ranchi", "jamshedpur", "patna",
    "bhubaneswar", "cuttack", "guwahati", "siliguri", "dehradun", "haridwar", "roorkee", "amritsar", "ludhiana", "jalandhar", "patala", "chandigarh",
    "panchkula", "mohali", "panipat", "karnal", "ambala", "meerut", "aligarh", "bareilly", "gorakhpur", "shimla", "srinagar", "jammu", "gangtok",
    "itanagar", "shillong", "agartala", "imphal", "aizawl", "kohima", "panaji", "margao", "ponda", "remote", "work-from-home", "wfh",
]

REMOTE_WORDS = (
    r"\b(remote|work from home|work-from-home|wfh|telecommute|anywhere|virtual|hybrid|home based)\b"
)
LOCATION_SEPARATOR = r"[,;/&|]|\b(?:and|or)\b"

# --- fixed values: words --------------------------------------------------

STOP_WORDS = [
    "a", "an", "the", "and", "or", "nor", "but", "for", "with", "about", "between", "through", "during", "before", "after", "above", "below", "from",
    "up", "down", "of", "in", "on", "at", "by", "to", "into", "over", "under", "again", "further", "then", "once", "here", "there", "all", "each",
    "every", "both", "few", "more", "most", "some", "any", "no", "not", "only", "own", "same", "so", "than", "too", "very", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "can", "this", "that", "these", "those", "it", "its", "our", "their", "your", "my", "his", "her", "they", "we", "you", "he", "she", "me",
    "overview", "summary", "description", "role", "position", "job", "apply", "learn", "join", "team", "via",
]

TITLE_STOP_WORDS = [
    "a", "an", "the", "and", "or", "of", "for", "to", "with", "in", "at", "on", "by", "as", "is", "are", "be", "it", "its", "our", "your", "you",
    "we", "us", "&", "+", "ii", "iii", "iv",
]

#: Title words per seniority level, tried in this order.
SENIORITY_WORDS = [
    ("entry", ["junior", "jr", "intern", "trainee", "entry", "graduate", "fresher", "apprentice"]),
    ("mid", ["mid", "midlevel", "intermediate", "ii"]),
    ("senior", ["senior", "sr", "lead", "principal", "staff", "architect", "iii", "iv", "v"]),
]

#: Skill -> written variants that count as the same skill.
SKILL_VARIANTS = {
    "kubernetes": ["kubernetes", "k8s", "k8"],
    "k8s": ["kubernetes", "k8s", "k8"],
    "amazon web services": ["aws", "amazon web services"],
    "aws": ["aws", "amazon web services"],
    "gitops": ["gitops", "ci/cd"],
    "ci/cd": ["ci/cd", "continuous integration", "continuous delivery", "gitops"],
    "c++": ["c++", "cpp"],
    "cpp": ["c++", "cpp"],
    "js": ["javascript", "js"],
    "javascript": ["javascript", "js"],
    "react.js": ["react", "reactjs"],
    "reactjs": ["react", "reactjs"],
}

PLACEHOLDERS = ["", "unknown", "naukri", "naukri.com", "untitled", "tba", "tbd", "na", "n/a", "none"]

#: Repository language -> skill.
LANGUAGE_SKILLS = {
    "python": "python",
    "javascript": "javascript",
    "typescript": "typescript",
    "go": "golang",
    "rust": "rust",
    "java": "java",
    "c++": "c++",
    "c": "c",
    "ruby": "ruby",
    "php": "php",
    "kotlin": "kotlin",
    "swift": "swift",
    "shell": "bash",
    "dockerfile": "docker",
    "html": "html",
    "css": "css",
    "terraform": "terraform",
    "sql": "sql",
    "jupyter notebook": "python",
}
TOPIC_SKILLS = [
    "kubernetes", "k8s", "docker", "aws", "gcp", "azure", "terraform", "machine-learning", "deep-learning", "data-science", "react", "nodejs",
    "fastapi", "django", "flask", "postgresql", "redis", "graphql", "linux",
]

GENERIC_COMPANY_WORDS = [
    "services", "solutions", "technologies", "technology", "systems", "labs", "consultancy", "consulting", "group", "global", "digital", "india",
    "infotech", "ventures",
]

SAVED_STATUSES = ["saved", "applied", "dismissed", "interview", "rejected", "offer"]

# --- fixed values: host labels --------------------------------------------

SKIP_DOMAIN_LABELS = [
    "www", "ww1", "ww2", "in", "uk", "de", "fr", "au", "ca", "br", "jp", "app", "careers", "jobs", "boards", "career", "join", "employment",
    "recruitment", "apply", "search", "job",
]
TLD_LABELS = [
    "com", "net", "org", "io", "co", "dev", "ai", "cloud", "tech", "in", "uk", "de", "fr", "au", "ca", "br", "jp", "sg", "ae", "eu", "nl", "se",
    "ch", "it", "es",
]
GENERIC_HOST_LABELS = [
    "opportunities", "recruiting", "talent", "career", "careers", "jobs", "job", "boards", "employment", "apply", "search", "candidate", "hiring",
    "join", "openings", "vacancies", "staffing", "workat", "careerpage", "jobsportal", "hr", "people",
]
PLATFORM_LABELS = [
    "avature", "myworkdayjobs", "workday", "greenhouse", "lever", "ashbyhq", "smartrecruiters", "icims", "taleo", "oraclecloud", "successfactors",
    "adp", "bamboohr", "recruitee", "jobvite", "pinpointhq", "workable", "teamtailor", "personio", "ultipro", "gethired", "breezy", "dover",
]

# --- fixed values: patterns -----------------------------------------------

SEARCH_PAGE_TITLES = [
    r"jobs\s+in\s",
    r"jobs\s+available",
    r"Top\s+\d+",
    r"\d+\+?\s+.*jobs",
    r"Job\s+Vacancies",
]
NON_POSTING_TITLES = [
    r"^page\s+\d+",
    r"^\d+\s*(jobs|results)",
    r"^(search|sign\s+in|log\s+in|register|apply)",
    r"^how\s+to\s+(become|learn|get)\s+",
    r"^(top\s+)?\d+\s*(skills|certifications?|courses?|ways)\s+(to|for)\b",
    r"^Job Application\s+for\s+",
    r"^Application\s+for\s+",
    r"^Sign\s+In",
    r"^Log\s+In",
]
NON_POSTING_URLS = [r"/auth/", r"/login", r"/signup", r"/register", r"/password/", r"/session/"]
PORTAL_NON_POSTING_PATHS = [
    "/code360/",
    "/campus/",
    "/blog/",
    "/interview-",
    "/cloudgateway",
    "companies.naukri.com",
    "-jobs-in-",
    "-jobs-careers-",
    "walkin-drives-jobs",
]
JUNK_TITLE = (
    r"^(link to\b|it jobs?$|it$|job(s)?$|hiring$|openings?$|vacanc(y|ies)$|"
    r"careers?$|sign in$|log in$|logon$|search$|apply now$|view (job|more)$|"
    r"see (all )?jobs?$|submit$|register$)"
    r"|(^|\s)(jobs? in|jobs? at|jobs? for|apply for)\b"
    r"|^top companies? (hiring|hiring for)\b"
    r"|(^|\s)companies? hiring for\b"
    r"|([\w-]+)\s+jobs?$"
    r"|([\w-]+)\s+careers?$"
    r"|^walk[ -]?in\s+(drive|drives|interview)s?\b"
    r"|^job listings?\b"
    r"|^join our (team|company|talent)\b"
)
FRAGMENT_ROLE_WORDS = (
    r"\b(engineer|developer|architect|sre|devops|analyst|manager|lead|specialist|"
    r"administrator|consultant|director|principal|head|staff|scientist|designer|"
    r"intern|trainee|associate|technician|operator|coordinator)\b"
)
RELEVANCE_ROLE_WORDS = (
    r"\b(engineer|developer|devops|sre|architect|analyst|manager|lead|principal|"
    r"staff|specialist|administrator|consultant|designer|scientist|operator|"
    r"coordinator|intern|trainee)\b"
)
URL_IN_TITLE = r"https?://|www\.|\.com/|\.jobs?/"
TRACKING_URL = r"(rc/clk|pagead/clk)"

COMPANY_BY_TEXT = [
    r"(?:at|by|via)\s+([A-Z][A-Za-z0-9&. ]+?)(?:\s+[-–]|\s+(?:is|has|in)\s+|$|\.)",
    r"([A-Z][A-Za-z0-9&. ]+?)\s+(?:is\s+)?(?:hiring|seeking|looking)",
]
#: What each of the two needs in the text; a scan for it spares most texts the costly pattern.
COMPANY_BY_TEXT_NEEDS = [r"(?:at|by|via)\s", r"\s(?:hiring|seeking|looking)"]
COMPANY_BY_TITLE = r"^([A-Z][A-Za-z0-9\s&.]+?)\s+(?:is\s+)?hiring\s+"
LOCATION_BY_TEXT = [
    r"in\s+([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{2})?)",
    r"([A-Z][a-zA-Z\s]+(?:,\s*[A-Z]{2}))(?:\s+[.…]|\s*$)",
]

LOCATION_BY_TEXT_NEEDS = [r"in\s", r",\s*[A-Z]{2}(?:\s+[.…]|\s*$)"]

DEAD_BODY_MARKERS = [
    "page not found",
    "job not found",
    "posting not found",
    "position not found",
    "not found or expired",
    "no longer accepting",
    "no longer available",
    "has been removed",
    "has been filled",
    "job expired",
    "job has expired",
    "position has been filled",
    "we're sorry",
]
DEAD_PATH_SEGMENTS = [
    "error", "errors", "not-found", "notfound", "page-not-found", "pagenotfound", "404", "expired", "job-expired", "job-expired-page", "jobnotfound",
    "job-not-found", "position-not-found", "posting-not-found", "vacancy-not-found", "no-longer-available",
]

MONTHS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]

# salary text
SALARY_UNIT_RANGE = r"(?:₹|rs\.?|inr)?\s*([\d.]+)\s*(?:-|–|to)\s*([\d.]+)\s*(lpa|lakhs?|lacs?)\b"
SALARY_UNIT_SINGLE = r"(?:₹|rs\.?|inr)?\s*([\d.]+)\s*(lpa|lakh|lacs?|l)\b"
SALARY_CRORE = r"(?:₹|rs\.?|inr)?\s*([\d.]+)\s*(?:-|–|to)?\s*([\d.]+)?\s*(cr|crores?)\b"
SALARY_AMOUNT_RANGE = r"(?:₹|rs\.?|inr)\s*([\d.]+)\s*(?:-|–|to)\s*(?:₹|rs\.?|inr)?\s*([\d.]+)"
SALARY_THOUSANDS = r"(?:₹|rs\.?|inr)?\s*([\d.]+)\s*(?:-|–|to)?\s*([\d.]+)?\s*(k|thousand)\b"
SALARY_MONTHLY = r"per\s*month|monthly|/month|/mo\b|\bmonths?\b|\bpm\b"
SALARY_UNDISCLOSED = r"not\s+disclosed|confidential|negotiable"

# rendered posting pages
DESCRIPTION_HEADING = (
    r"^(about (the )?job|job description|job details|role[:\-]?\s*responsibilities|"
    r"responsibilities|what you[’']?ll do|key responsibilities)$"
)
STOP_HEADING = (
    r"^(key skills?|skills required|skills|about company|about (the )?company|salary|"
    r"education|perks|benefits|how to apply|job opening details|requirements?|"
    r"qualifications|additional information|contact)$"
)
SKILLS_HEADING = r"^(key skills?|skills required|skills)$"
SKILLS_STOP = r"^(about company|salary|education|experience|employment type)$"
PAGE_SALARY_UNIT = (
    r"(?:₹|rs\.?|inr)?\s*([\d,]+(?:\.\d+)?)\s*(?:-|–|to)\s*([\d,]+(?:\.\d+)?)\s*"
    r"(lpa|lakhs?|lacs?|thousand|k|pa|per annum)\b"
)
PAGE_SALARY_PLAIN = (
    r"(?:₹|rs\.?|inr)\s*([\d,]+(?:\.\d+)?)\s*(?:-|–|to)?\s*([\d,]+(?:\.\d+)?)?\s*"
    r"(lpa|lakhs?|lacs?)?\b"
)
PAGE_EXPERIENCE_RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)\s*(?:years|yrs|year|yr)\b"
PAGE_EXPERIENCE_SINGLE = r"(\d+(?:\.\d+)?)\s*(?:years|yrs|year|yr)\b"
PAGE_LISTED_RELATIVE = (
    r"(?:posted|updated|published)\s*:?\s*([a-z0-9 ,:\-]{1,40}?(?:ago|today|yesterday|just now))"
)
PAGE_LISTED_DATE = (
    r"(?:posted|updated|published)\s*:?\s*"
    r"((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:,?\s+\d{4})?)"
)
PAGE_APPLY_LINK = r"\[(?:apply|apply now|easy apply)\]\((https?://[^)\s]+)\)"
PAGE_APPLY_URL = r"\[[^\]]*\]\((https?://[^)\s]*(?:apply|jobs/apply)[^)\s]*)\)"
TITLE_ARTIFACT = (
    r"^(employment type|job description|job details|responsibilities|about the job|"
    r"key skills?|skills required|##|###|\d+[.)]\s|full[- ]?time|part[- ]?time)"
)

# credentials in text
URL_USERINFO = r"([A-Za-z][A-Za-z0-9+.\-]{0,19}://)[^/\s@]+@"
BARE_USERINFO = r"(?<![A-Za-z0-9._%+\-])[^:/\s@]+:[^/\s@]+@(?=[A-Za-z0-9.\-\[])"
SECRET_QUERY_VALUE = (
    r"([?&#](?:access[_-]?token|auth[_-]?token|token|bearer|api[_-]?key|key|password|passwd|secret|"
    r"signature|sig|session(?:id)?|cookie|credential)=)[^&#\s]*"
)

PROFILE_ROLE = (
    r"(DevOps\s*(?:Engineer|Developer)?|Software\s*(?:Engineer|Developer|Architect)"
    r"|Cloud\s*Engineer|SRE|Site\s*Reliability|Platform\s*Engineer"
    r"|Data\s*(?:Engineer|Scientist|Analyst)|ML\s*Engineer"
    r"|Full.?Stack|Frontend|Backend|Product\s*Manager"
    r"|Engineering\s*Manager|Tech\s*Lead)"
)

# --- fixed values: titles and companies of search hits ----------------------

BOARD_SUFFIX = r"\s*[-–|]\s*(?:LinkedIn|Indeed|Glassdoor|Monster|ZipRecruiter).*"
NOISE_SUFFIX = r"\s*[-–|]\s*(?:Hiring|Job|Opening|Vacancy).*"
HIRING_LEAD = r"^\s*[A-Z][A-Za-z0-9&.]+\s+(?:is\s+)?hiring\s+"
PORTAL_SLUG_COMPANY = r"/job-listings-[^/]+?-([a-z]+(?:-[a-z]+)*)-\d"
PORTAL_TITLE_COMPANY = r"[-–]\s*([A-Z][A-Za-z0-9\s&.]+?)\s*$"
PORTAL_SLUG_TITLE = r"/job-listings-([^/]+?)-(\d)"
PLACE_AT_END = r"\s+in\s+[A-Z][a-zA-Z\s,]*$"
SITE_COMPANY = r"\b(at|by|via)\s+([A-Z][A-Za-z0-9&. ]+?)(?:\s+[-–]|\s+(?:is|has|in)\s+|\.|$)"

#: Ordered rewrites of a portal title: (pattern, ignore case, trim after).
PORTAL_TITLE_REWRITES = [
    (r"\s*[-–|]\s*Naukri\.?com.*", True, False),
    (NOISE_SUFFIX, True, False),
    (r"\s*[-–]\s*\d+.*", False, False),
    (r"Apply\s+To\s*\d*", True, True),
    (r"^\d+\s+", False, False),
    (r"\s+-\s+\d+.*", False, False),
    (r"\s*\d+\s*(?:Job|Vacanc)", True, False),
    (r"\s*[-–|]\s*(?:naukri\s*(?:job|opening).*)", True, False),
    (r"\s+Jobs\s+(?:In\s+)?.*", True, True),
    (r"\s+-\s+.*", False, True),
    (r"^(?:How to|Career in|Internship In|Careers in)\s+.*", True, True),
]

# --- fixed values: limits and weights -------------------------------------

TITLE_SIMILARITY = 82
COMPANY_SIMILARITY = 88
QUERY_SIMILARITY = 85
BREAKER_FAILURES = 3
BREAKER_COOLDOWN = 1800
CACHE_MAX_AGE = 7 * 86400
QUERY_CAPS = {"Career Sites": 2, "Web Search": 6, "Naukri": 3}
KEYWORD_WEB_CAP = 3
WINDOW_DAYS = {"today": 1, "3days": 3, "week": 7, "month": 30}
POSTING_HOSTS = ["greenhouse.io", "lever.co", "jobs.ashbyhq.com", "boards.greenhouse.io"]
BOARD_HOSTS = ["myworkdayjobs.com", "greenhouse.io", "lever.co", "icims.com", "smartrecruiters.com"]
