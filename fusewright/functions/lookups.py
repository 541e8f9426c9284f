"""Names, weights and patterns that results depend on."""

SKILLS = {
    # fields
    "ai": "Artificial Intelligence", "a.i.": "Artificial Intelligence", "artificial intelligence": "Artificial Intelligence",
    "ml": "Machine Learning", "machine learning": "Machine Learning", "deep learning": "Deep Learning", "dl": "Deep Learning",
    "nlp": "Natural Language Processing", "natural language processing": "Natural Language Processing",
    "cv": "Computer Vision", "computer vision": "Computer Vision",
    # languages
    "python": "Python", "py": "Python", "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript",
    "java": "Java", "c++": "C++", "cpp": "C++", "c#": "C#", "csharp": "C#", "golang": "Go", "go": "Go", "rust": "Rust", "ruby": "Ruby",
    "sql": "SQL", "nosql": "NoSQL",
    # frameworks
    "react": "React", "reactjs": "React", "react.js": "React", "vue": "Vue.js", "vuejs": "Vue.js", "vue.js": "Vue.js",
    "angular": "Angular", "angularjs": "Angular", "node": "Node.js", "node.js": "Node.js", "nodejs": "Node.js",
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "spring": "Spring", "spring boot": "Spring Boot",
    # data
    "pandas": "Pandas", "numpy": "NumPy", "tensorflow": "TensorFlow", "tf": "TensorFlow", "pytorch": "PyTorch", "torch": "PyTorch",
    "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "scikit learn": "scikit-learn",
    # clouds and operations
    "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud": "GCP", "google cloud platform": "GCP",
    "azure": "Azure", "microsoft azure": "Azure", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "terraform": "Terraform", "ci/cd": "CI/CD", "cicd": "CI/CD", "git": "Git", "github": "GitHub", "gitlab": "GitLab",
    # databases
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "mongo": "MongoDB",
    "redis": "Redis", "elasticsearch": "Elasticsearch",
    # other
    "rest api": "REST API", "restapi": "REST API", "rest": "REST API", "graphql": "GraphQL", "microservices": "Microservices",
    "agile": "Agile", "scrum": "Scrum",
}

PLACES = {
    "sf": "San Francisco, CA", "nyc": "New York, NY", "la": "Los Angeles, CA", "dc": "Washington, DC", "blr": "Bengaluru, India",
    "bangalore": "Bengaluru, India", "bombay": "Mumbai, India", "hyd": "Hyderabad, India", "pune": "Pune, India",
    "chn": "Chennai, India", "madras": "Chennai, India",
}

PRIORITY = {"resume": 0, "ats": 1, "github": 2, "csv": 3, "derived": 4}  # smaller wins
BASELINE = {"resume": 0.92, "ats": 0.90, "csv": 0.80, "github": 0.86}
DOCUMENTED_BASELINE = {"resume": 0.95, "ats": 0.90, "csv": 0.82, "github": 0.88}
OTHER_BASELINE = 0.70
WEIGHTS = {"full_name": 0.20, "emails": 0.20, "phones": 0.10, "location": 0.05, "skills": 0.15, "experience": 0.15, "education": 0.10, "years_experience": 0.05}
ENTRY_CONFIDENCE = 0.85  # of an experience or education entry

EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PRESENT = r"(?i)^(present|current|now|ongoing|—|-+)$"
NULL_WORDS = ["nan", "none", "null", "n/a", "na", "-", ""]
# calling code: first digits of national numbers and how many digits these have, after the public numbering plans
PHONES = {
    "1": "2-9:10", "7": "3-9:10", "20": "1:10 2:9 3-9:8-9", "27": "1-8:9", "30": "2:10 6:10", "31": "1-8:9", "32": "1-3:8 4:8-9 5-9:8", "33": "1-9:9", "34": "6-9:9", "36": "1:8 2-9:8-9",
    "39": "0:6-11 3:9-10", "40": "2-3:9 7:9", "41": "2-9:9", "43": "1-9:7-13", "44": "1-2:9-10 7:10", "45": "2-9:8", "46": "1-9:7-9", "47": "2-9:8", "48": "1-9:9", "49": "1-9:7-11",
    "51": "1:8 4-8:8 9:9", "52": "1-9:10", "54": "1-3:10 9:11", "55": "1-9:10-11", "56": "2-9:9", "57": "3:10 6:10", "60": "1:9-10 3:9 4-9:8", "61": "2-4:9 7-8:9", "62": "2-7:8-11 8:9-12", "63": "2-8:9 9:10",
    "64": "2:8-10 3-9:8", "65": "3:8 6:8 8-9:8", "66": "2-5:8 6:9 7:8 8-9:9", "81": "1-6:9 7-9:9-10", "82": "1:9-10 2:8-9 3-6:8-10", "84": "2:10 3:9 5:9 7-9:9", "86": "1:11 2:10 3-9:9-11", "90": "2-5:10", "91": "6-9:10",
    "92": "2:8-10 3:10 4-9:8-10", "94": "1-9:9", "233": "2-3:9 5:9", "234": "1:8 7-9:10", "254": "1:9 2:7-9 7:9", "351": "2-3:9 9:9", "353": "1-9:7-9", "358": "1-9:5-12", "380": "3-7:9 9:9", "852": "2-3:8 5-6:8 9:8",
    "880": "1:10 2-9:8-10", "886": "2-8:8-9 9:9", "965": "2:8 5-6:8 9:8", "966": "1:9 5:9", "971": "2-9:8-9", "972": "2-4:8 5:9 7:9 8-9:8", "974": "3-7:8", "977": "1:8 9:10",
}
NANP = ("1", 4, "2")  # of calling code 1 the fourth national digit is 2 at least
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DATE_FILLERS = [".", ",", ";", "-", "/", "'", "at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th"]
SECTIONS = {
    "experience": ["experience", "work experience", "professional experience", "employment", "employment history", "work history", "career history"],
    "education": ["education", "academic background", "qualifications", "academic qualifications", "educational background"],
    "skills": ["skills", "technical skills", "core competencies", "competencies", "technologies", "tools", "stack"],
    "projects": ["projects", "personal projects", "open source", "side projects"],
    "summary": ["summary", "profile", "objective", "about me", "professional summary", "career objective"],
    "links": ["links", "social", "online profiles", "portfolio"],
}
HEADERS = {
    "full_name": ["name", "full name", "candidate name", "candidate_name", "applicant_name", "applicant name"],
    "emails": ["email", "email address", "email_address", "e-mail"],
    "phones": ["phone", "phone number", "phone_number", "mobile", "mobile number", "cell"],
    "location": ["location", "city", "address", "city/state"],
    "skills": ["skills", "skill set", "skillset", "technical skills"],
    "years_experience": ["years_experience", "years experience", "experience", "yoe"],
    "linkedin": ["linkedin"],
    "github_url": ["github", "github url"],
    "portfolio": ["portfolio", "website"],
    "headline": ["headline", "title", "job title", "current title"],
    "candidate_id": ["id", "candidate_id", "applicant_id"],
}
WRAPPERS = ["candidate", "applicant", "data", "result"]
ATS_KEYS = {
    "full_name": ["full_name", "name", "candidate_name", "applicant_name", "firstName", "first_name", "display_name"],
    "first": ["first_name", "firstName", "given_name", "givenName"],
    "last": ["last_name", "lastName", "family_name", "surname"],
    "emails": ["email", "emails", "email_address", "email_addresses", "emailAddress", "emailAddresses", "primary_email"],
    "phones": ["phone", "phones", "phone_number", "phone_numbers", "phoneNumber", "phoneNumbers", "mobile", "cell"],
    "location": ["location", "address", "city", "current_location", "currentLocation", "residence", "city_state"],
    "headline": ["headline", "title", "current_title", "currentTitle", "job_title", "jobTitle", "position"],
    "skills": ["skills", "skill_tags", "skillTags", "technical_skills", "technicalSkills", "competencies", "tags"],
    "links": ["links", "social_links", "socialLinks", "profiles", "social_profiles", "socialProfiles", "urls"],
    "linkedin": ["linkedin", "linkedin_url", "linkedinUrl", "linkedin_profile"],
    "github": ["github", "github_url", "githubUrl", "github_profile"],
    "portfolio": ["portfolio", "website", "personal_site", "portfolioUrl"],
    "experience": ["experience", "work_experience", "workExperience", "positions", "jobs", "employment", "employment_history"],
    "education": ["education", "education_history", "educationHistory", "academic_background", "qualifications"],
    "years_experience": ["years_experience", "years_of_experience", "yearsOfExperience", "experience_years", "experienceYears", "total_experience"],
    "candidate_id": ["candidate_id", "id", "applicant_id", "candidateId", "applicantId", "ats_id", "external_id"],
}
LANGUAGE_SKILLS = {"Shell": "Shell Scripting", "Jupyter Notebook": "Python"}  # other languages keep their name
DEFAULT_ALIASES = {"full_name": "name", "emails": "email_addresses", "phones": "phone_numbers", "years_experience": "experience_years"}
JOB_KEYS = {
    "title": ["title", "job_title", "role"], "company": ["company", "employer", "organization"], "start_date": ["start_date", "startDate", "from"], "end_date": ["end_date", "endDate", "to"],
    "description": ["description", "summary", "responsibilities"], "location": ["location"],
}
STUDY_KEYS = {
    "institution": ["institution", "school", "university", "college"], "degree": ["degree", "degree_type", "qualification"], "field_of_study": ["field_of_study", "major", "subject", "course"],
    "start_date": ["start_date", "startDate"], "end_date": ["end_date", "endDate", "graduation_date", "graduationDate"], "gpa": ["gpa", "grade"],
}
# what a résumé's text is searched for
MAIL_IN_TEXT = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_IN_TEXT = r"\+?[\d\-()\s]{7,16}"
URL_IN_TEXT = r"(?i)(?:https?://|www\.)[^\s)\],\"']+|(?:linkedin\.com|github\.com|gitlab\.com)[^\s)\],\"']*"
ROLES = "engineer|developer|scientist|analyst|manager|architect|designer|consultant|specialist|lead|director|intern|researcher|officer"
MONTH_IN_TEXT = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{4}|\d{1,2}/\d{4}|\d{4}"
RANGE_IN_TEXT = rf"(?i)({MONTH_IN_TEXT})\s*(?:–|-|to)\s*({MONTH_IN_TEXT}|present|current|now)"
DEGREE_IN_TEXT = r"(?i)\b(B\.?Tech|B\.?E\.?|B\.?Sc\.?|B\.?S\.?|B\.?A\.?|M\.?Tech|M\.?E\.?|M\.?Sc\.?|M\.?S\.?|M\.?A\.?|MBA|Ph\.?D\.?|Doctor|Bachelor|Master|Associate|Diploma)\b"
GPA_IN_TEXT = r"(?i)\bGPA[:\s]+(\d+\.\d+)"
YEARS_IN_TEXT = r"(?i)(\d+\+?)\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience|exp)"
# deltas of the quality rules
NAME_OF_TWO_WORDS, LONG_NAME = 0.05, -0.05
EMAIL_PRESENT, LONG_EMAIL = 0.03, -0.05
PHONE_PRESENT, PLACE_WITH_COMMA = 0.02, 0.03
YEARS_PLAUSIBLE, MANY_YEARS = 0.03, -0.10
SKILL_OF_THREE, SKILL_OF_TEN = 0.03, 0.02
DEFAULT_PROJECTION = {"hide_provenance": False, "hide_confidence": False, "field_aliases": DEFAULT_ALIASES, "exclude_fields": []}
REPORT_VERSION = "1.0.0"
