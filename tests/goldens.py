"""Published extraction, redaction and routing results, and the 15-record catalogue
they refer to (key columns only)."""

BUDGET = [
    ("fees under 1.5 lakh", 150_000), ("budget of 2 lakhs", 200_000), ("I can afford 1L per year", 100_000),
    ("college under 2.5 lakhs", 250_000), ("budget 90k", 90_000), ("under 150k", 150_000),
    ("fee below 75000", 75_000), ("college costing 1,50,000", 150_000), ("1 lakh per semester", 200_000),
    ("50k per sem", 100_000), ("budget 75000 per semester", 150_000), ("which college is best for me", None),
    ("I scored 78 percent", None), ("founded in 2004", None), ("1 lakh half-yearly", 200_000),
    ("budget 80000 six month instalment", 160_000), ("fee is 250000", 250_000),
    ("I want a college with 4 courses", None),
    ("assembly hall fee 60000", 120_000), ("budget 2000 l", 200_000_000), ("placement above 5 lakhs", 500_000),
    ("1,2,3,4,5,6", 123_456), ("बजट १५०००० रुपये", 150_000), ("", None), (None, None),
]
CUTOFF = [
    ("I scored 78%", 78), ("aggregate of 85.5 percent", 85.5), ("85 percentage in class 12", 85),
    ("I scored 72 in boards", 72), ("got 65 marks in class 12", 65), ("cutoff of 80", 80), ("score 55", 55),
    ("aggregate 90", 90), ("I scored 25", None), ("I scored 105", None), ("which MBA colleges are there", None),
    ("fees under 1.5 lakh", None), ("budget 90k, scored 75", 75), ("I got 82.5 percent", 82.5),
    ("cutoff of 70 for engineering", 70),
    ("78% and", None), ("78%x", 78), ("25 percent scholarship", 25), ("I have 50 thousand", 50),
    ("score high, 75 last year", None),
]
PLACEMENT = [
    ("placement above 5 LPA", 5), ("placements at least 6 lpa", 6), ("placement over 4.5 lpa", 4.5),
    ("placement above 5 lakhs", 5), ("placements greater than 7 lakh", 7), ("placement of 6L", 6),
    ("placement minimum 8", 8), ("min placement 5", 5), ("engineering college with hostel", None),
    ("fees under 1.5 lakh", None), ("which MBA is cheapest", None),
    ("MBA under 1.8 lakh with placement above 5 lakhs", 5), ("placement above 6.5 lpa", 6.5),
    ("placement cell with 240 seats", 240), ("5 LPA placement", 5),
]
EXHAUSTIVE = [
    ("Does any college offer it", True), ("are there any hostels", True), ("everything about fees", False),
    ("which colleges", False), ("list of options", False), ("ALL of them", True), ("each one", True),
    ("anyone", False),
]
REDACTED = [
    ("my email is admin.counselor@college.org", "my email is [EMAIL_MASKED]"),
    ("contact me at 9876543210 immediately", "contact me at [PHONE_MASKED] immediately"),
    ("my family income is 3.5 lakhs", "my family income [INCOME_MASKED]"),
    ("income Rs 500000", "income [INCOME_MASKED]"),
    ("Contact testing@mme.com or 1234567890. Family income is Rs 400000.",
     "Contact [EMAIL_MASKED] or [PHONE_MASKED]. Family income [INCOME_MASKED]."),
    ("123456789012", "[PHONE_MASKED]"), ("1234 5678 9012", "[AADHAAR_MASKED]"),
    ("+91 9876543210", "+[PHONE_MASKED]"), ("(987) 654-3210", "([PHONE_MASKED]"),
    ("Rs 175000", "[INCOME_MASKED]"), ("Rs 98,000", "Rs 98,000"),
    ("a@b.c-d@e.f", "[EMAIL_MASKED][EMAIL_MASKED]"), ("", ""), (None, None),
]

# id, name, type, fee, cutoff, hostel, placement, courses
COLLEGES = [
    ("C001", "North Ridge Institute of Technology", "Private", 145000, 82.0, "Yes", 6.5, "B.Tech CSE; B.Tech ME; B.Tech ECE"),
    ("C002", "Ganga Valley University", "Private", 98000, 68.0, "Yes", 4.2, "BBA; B.Com; BCA; MBA"),
    ("C003", "Himalayan College of Engineering", "Private", 132000, 75.0, "Yes", 5.8, "B.Tech CSE; B.Tech Civil; B.Tech EE"),
    ("C004", "Doon Business School", "Private", 175000, 72.0, "Yes", 7.1, "BBA; MBA; PGDM"),
    ("C005", "Shivalik Government Polytechnic", "Government", 22000, 60.0, "No", 3.4, "Diploma CSE; Diploma ME; Diploma Civil"),
    ("C006", "Nainital Institute of Medical Sciences", "Private", 850000, 91.0, "Yes", 0.0, "MBBS; BDS; B.Sc Nursing"),
    ("C007", "Kumaon Arts and Science College", "Government", 15000, 55.0, "Yes", 2.8, "B.A; B.Sc; B.Com; M.A"),
    ("C008", "Rishikesh Institute of Design", "Private", 210000, 65.0, "Yes", 5.2, "B.Des; B.F.A; M.Des"),
    ("C009", "Terai Technical University", "Deemed", 118000, 70.0, "Yes", 6.0, "B.Tech CSE; B.Tech ME; MCA; M.Tech"),
    ("C010", "Mussoorie College of Hotel Management", "Private", 165000, 62.0, "Yes", 4.9, "BHM; B.Sc Hospitality; Diploma Culinary"),
    ("C011", "Haldwani Law College", "Government", 28000, 74.0, "No", 4.0, "LLB; BA-LLB; LLM"),
    ("C012", "Ambedkar National Institute", "Government", 45000, 88.0, "Yes", 8.4, "B.Tech; B.Arch; M.Tech"),
    ("C013", "Char Dham Pharmacy College", "Private", 95000, 66.0, "Yes", 4.1, "B.Pharm; D.Pharm; M.Pharm"),
    ("C014", "Ganga Institute of Commerce", "Private", 72000, 63.0, "Yes", 3.9, "B.Com; BBA; M.Com; CA-Foundation"),
    ("C015", "Silver Peak School of Media", "Private", 138000, 60.0, "Yes", 4.3, "BJMC; BA-Film; MA-Mass Comm"),
]
_ALL = {c[0] for c in COLLEGES}

# question -> (route, pool before ranking)
ROUTES = [
    ("I scored 78% and have a budget of ₹1.5 lakh/year — which engineering colleges can I consider?", "constrained", {"C003", "C005", "C009"}),
    ("Which colleges offer an MBA, and what do they cost?", "constrained", {"C002", "C004"}),
    ("List the government colleges that have hostel facilities.", "constrained", {"C007", "C012"}),
    ("What's the average placement package at North Ridge Institute of Technology?", "named", {"C001"}),
    ("Does Ganga Valley University offer a PhD in Physics?", "named", {"C002"}),
    ("Which colleges offer scholarships for students from low-income families?", "open", _ALL),
    ("Which college is best for me? I have ₹1 lakh per semester.", "constrained", _ALL - {"C006", "C008"}),
    ("What are the fees at Doon Business School per semester?", "named", {"C004"}),
    ("I scored 40% in Class 12, which engineering colleges can I get into?", "constrained", set()),
    ("What is the average placement package at Nainital Institute of Medical Sciences?", "named", {"C006"}),
    ("Does Shivalik Government Polytechnic offer a B.Tech degree?", "named", {"C005"}),
    ("Does Ganga Institute of Commerce offer an MBA?", "named", {"C014"}),
    ("Does Terai Technical University offer a B.Des programme?", "named", {"C009"}),
    ("What are the annual fees at Garhwal Central University?", "open", _ALL),
    ("Which colleges offer scholarships or fee concessions for low-income families?", "open", _ALL),
    ("What is the total yearly cost to study at Rishikesh Institute of Design, including everything?", "named", {"C008"}),
    ("Which engineering college is best for me? I scored 80% and have a budget of Rs 1.5 lakh/year.", "constrained", {"C003", "C005", "C009"}),
    ("placement above 5 lakhs", "constrained", {"C001", "C003", "C004", "C008", "C009", "C012"}),
    ("government law colleges", "named", {"C011"}),
    ("college of engineering near me", "named", {"C003"}),
    ("hotel management colleges", "named", {"C010"}),
    ("I have 50 thousand", "constrained", set()),
    ("assembly hall fee 60000", "constrained", {"C002", "C005", "C007", "C009", "C011", "C012", "C013", "C014"} & {c[0] for c in COLLEGES if c[3] <= 120000}),
    ("placement cell with 240 seats", "constrained", set()),
    ("colleges without hostel", "open", _ALL),
    ("colleges that don't have hostel", "constrained", _ALL - {"C005", "C011"}),
    ("budget 2000 l", "constrained", _ALL),
    ("MBA under 1.8 lakh with placement above 5 lakhs", "constrained", {"C004"}),
    ("score high, 75 last year", "open", _ALL),
    ("Does any college have hostel facilities?", "constrained", _ALL - {"C005", "C011"}),
]
