"""Word lists and rubrics. Fixed values, as plain data; pass others to the operators to change them."""

# Substitutions for words that OCR misreads, applied in this order, in any case.
OCR_WORDS = [
    ("Pyth0n", "Python"), ("Pythn", "Python"), ("Phyton", "Python"), ("Tensor Fl0w", "TensorFlow"), ("Tensorflow", "TensorFlow"),
    ("Panda5", "Pandas"), ("Pandass", "Pandas"), ("NumpY", "NumPy"), ("Num Py", "NumPy"), ("Open CV", "OpenCV"), ("Scikit Learn", "Scikit-Learn"),
    ("Git Hub", "GitHub"), ("Linkedln", "LinkedIn"), ("Micr0soft", "Microsoft"), ("GmaiI", "Gmail"), ("Amaz0n", "Amazon"), ("Pyt0rch", "PyTorch"),
    ("Tensor FIow", "TensorFlow"), ("Kera5", "Keras"), ("E-maiI", "Email"), ("MaiI", "Mail"),
]

# Case-sensitive substitutions in resumes.
RESUME_WORDS = [
    ("Pyth0n", "Python"), ("Machlne", "Machine"), ("Learnlng", "Learning"), ("TensorfIow", "TensorFlow"), ("Git Hub", "GitHub"),
    ("Linked In", "LinkedIn"), ("SqL", "SQL"), ("Javascrlpt", "JavaScript"), ("C Plus Plus", "C++"), ("AWSs", "AWS"),
]

# The skill dictionary.
SKILLS = [
    "Python", "SQL", "Machine Learning", "Deep Learning", "TensorFlow", "PyTorch", "Pandas", "NumPy", "OpenCV", "FastAPI", "Flask", "Docker", "Git",
    "Power BI", "Excel", "AWS", "Azure", "Spark", "Linux", "Java", "C++", "NLP", "Accounting", "General Accounting", "Accounts Payable",
    "Accounts Receivable", "Financial Reporting", "Program Management", "ERP", "SAP", "Oracle", "QuickBooks", "Budgeting", "Auditing", "Finance",
    "Mathematics", "Physics", "Teaching", "Tutoring", "Classroom Management", "Lesson Planning", "Student Communication", "Subject Knowledge",
    "Curriculum Development", "Academic Support", "Educational Planning", "Online Teaching", "Private Tutoring", "Communication Skills",
    "Problem Solving", "Time Management",
]

# Places that the gazetteer knows.
CITIES = ["Karachi", "Lahore", "Islamabad", "Rawalpindi", "Peshawar", "Quetta", "Multan", "Faisalabad", "Hyderabad", "Sialkot", "Gujranwala", "Bahawalpur", "London", "Dubai", "New York", "Toronto"]

# Words that make a line an organisation's.
ORGANISATION_WORDS = ["University", "College", "Institute", "Company", "Ltd", "Limited"]

# Currency codes of the short parser.
CURRENCIES = ["PKR", "USD", "EUR", "GBP", "AED", "SAR", "INR", "MYR"]

# Section headings of resumes.
SECTIONS = {
    "summary": ["professional summary", "summary", "profile", "objective", "about me", "career objective", "professional profile", "personal profile"],
    "contact": ["contact", "contacts", "contact information", "contact details", "personal details"],
    "skills": ["skills", "technical skills", "core skills", "key skills", "professional skills", "competencies"],
    "experience": ["experience", "professional experience", "work experience", "employment", "employment history", "work history", "teaching experience", "professional background", "career history"],
    "projects": ["projects", "project", "academic projects", "personal projects", "portfolio projects", "key projects"],
    "education": ["education", "academic background", "academic qualification", "qualifications", "qualification", "educational background"],
    "certifications": ["certifications", "certificates", "licenses", "licences", "professional certifications"],
    "languages": ["languages", "language", "language skills"],
}

# Evidence patterns of the document router.
INVOICE_EVIDENCE = [
    r"\binvoice\b", r"\binvoice\s*(?:no|number|#|date|id)\b", r"\bbill\s*to\b", r"\bship\s*to\b", r"\bsubtotal\b", r"\bsub\s*total\b", r"\bgrand\s*total\b",
    r"\bamount\s*due\b", r"\btotal\s*(?:amount|payable)\b", r"\b(?:gst|vat|sales tax|service tax)\b", r"\bpayment\s*(?:method|terms|mode)\b",
    r"\bunit\s*price\b", r"\b(?:quantity|qty)\b", r"\bdescription\b", r"\bdue\s*date\b",
]
RESUME_EVIDENCE = [
    r"\bwork\s+experience\b", r"\bprofessional\s+experience\b", r"\beducation\b", r"\bskills\b", r"\bprojects\b", r"\bcertifications?\b",
    r"\blanguages\b", r"\bprofessional\s+summary\b", r"\bcurriculum\s+vitae\b", r"\blinkedin\b", r"\bgithub\b", r"\bobjective\b",
]
FINANCE_EVIDENCE = [r"\bsubtotal\b", r"\btotal\b", r"\bamount\b", r"\b(?:gst|vat|tax)\b", r"\bunit\s*price\b", r"\b(?:qty|quantity)\b"]

# Labels of invoices.
INVOICE_LABELS = ["invoice no", "invoice number", "invoice #", "invoice id", "inv no", "inv number", "inv #", "bill no", "bill number", "receipt no", "receipt number", "reference no", "reference number", "ref no", "ref number"]
DATE_LABELS = ["invoice date", "bill date", "issue date", "issued date", "date of issue", "date"]
DUE_LABELS = ["due date", "payment due", "due on", "pay by"]
CUSTOMER_LABELS = ["bill to", "billed to", "customer", "customer name", "sold to", "ship to", "client", "client name", "buyer", "buyer name", "recipient"]
VENDOR_LABELS = ["from", "seller", "seller name", "vendor", "vendor name", "supplier", "supplier name", "merchant", "merchant name", "company", "business", "issued by"]
TOTAL_LABELS = ["grand total", "total due", "amount due", "balance due", "net payable", "total payable", "invoice total", "total amount", "amount payable", "payable", "total"]
SUBTOTAL_LABELS = [
    "subtotal", "sub total", "net amount", "net total", "amount before tax", "before tax", "taxable amount", "total before tax", "total excluding tax",
    "total excluding vat", "total excluding gst", "total exclusive tax", "total exclusive vat", "total exclusive gst", "tax exclusive total",
    "net payable before tax", "total exclude gst", "total exclude vat", "total exclude tax",
]
TAX_LABELS = ["tax amount", "tax total", "total tax", "vat amount", "total vat", "gst amount", "total gst", "sales tax amount", "service tax amount"]
DISCOUNT_LABELS = ["discount", "discount amount", "less discount"]
PAYMENT_LABELS = ["payment method", "payment mode", "paid by", "payment type", "method of payment"]
STOP_HEADERS = [
    "invoice", "tax invoice", "bill", "receipt", "items", "item", "description", "description of goods", "products", "product", "services", "service",
    "subtotal", "sub total", "tax", "vat", "gst", "discount", "total", "grand total", "amount due", "payment", "payment method", "terms", "notes",
    "thank you", "customer", "bill to", "sold to", "ship to",
]
PAYMENT_METHODS = [
    "visa card", "mastercard", "american express", "amex", "credit card", "debit card", "visa", "bank transfer", "wire transfer", "cash", "cheque", "check",
    "paypal", "stripe", "apple pay", "google pay", "online payment",
]
CURRENCY_CODES = [
    "USD", "EUR", "GBP", "PKR", "INR", "AED", "SAR", "QAR", "KWD", "BHD", "OMR", "MYR", "SGD", "AUD", "CAD", "NZD", "JPY", "CNY", "CHF", "HKD", "THB", "BDT",
    "NPR", "LKR", "ZAR", "NGN", "KES", "EGP", "TRY", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "RON", "BRL", "MXN",
]
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "₨": "PKR", "¥": "JPY"}

# Tenders of receipts, in the order they are tried on a line.
TENDERS = {
    "CREDIT": r"\bCREDIT\s+(?:TEND|TENDER)\b|\bCREDIT CARD\b",
    "DEBIT": r"\bDEBIT\s+(?:TEND|TENDER)\b|\bEFT\s+DEBIT\b",
    "CASH": r"\bCASH\b",
    "CHECK": r"\b(?:CHECK|CHEQUE)\s+(?:TEND|TENDER)\b",
    "VISA": r"\bVISA\s+(?:TEND|TENDER)\b",
    "MASTERCARD": r"\bMASTER\s*CARD\s+(?:TEND|TENDER)\b",
    "AMEX": r"\bAMEX\s+(?:TEND|TENDER)\b",
}

#: Words of which each line with a tender has one.
TENDER_WORDS = ["CREDIT", "DEBIT", "CASH", "CHECK", "CHEQUE", "VISA", "MASTER", "AMEX"]

# Words of the summary and footer of a receipt.
RECEIPT_SUMMARY = ["SUBTOTAL", "TOTAL", "TAX", "CHANGE", "CASH TEND", "DEBIT TEND", "CREDIT TEND", "REF #", "TC#", "TERMINAL", "APPROVAL", "NETWORK", "PAYMENT SERVICE", "ITEMS SOLD", "TOTAL NUMBER", "CHECK/MEMBER"]

# Personal fields of forms and the labels that name them, in order of preference.
PERSONAL_LABELS = {
    "name": ["name", "full name", "applicant name", "employee name"],
    "date_of_birth": ["date of birth", "dob", "birth date"],
    "email": ["email", "email address", "e-mail"],
    "phone": ["phone", "phone number", "telephone", "mobile"],
    "cnic": ["cnic", "cnic number", "national id", "national id number"],
    "address": ["address", "home address", "mailing address"],
    "gender": ["gender", "sex"],
}
CHECKBOX_MARKS = ["x", "xx", "✓", "✔", "☑", "checked", "[x]", "[xx]", "yes", "true"]
FORM_INSTRUCTIONS = ["check one", "appendix c", "reportable expenditures", "in thousands", "from current budget", "from next year's budget", "supplier rpt.", "current year", "10% change", "original -", "field complete", "wave(s)"]

# Points of the resume rubric.
RUBRIC = {"name": 10, "email": 10, "phone": 10, "skills": 20, "education": 15, "experience": 15, "projects": 5, "certifications": 5, "linkedin": 5, "github": 5}

# Headings, words and phrases of studies in resumes.
EDUCATION_HEADINGS = [
    "education", "educational background", "education background", "academic background", "academic qualifications", "academic history", "qualifications",
    "educational qualifications", "education & qualifications", "education and qualifications",
]
EDUCATION_ENDS = [
    "experience", "work experience", "professional experience", "employment", "employment history", "career history", "work history", "skills", "technical skills",
    "professional skills", "core skills", "key skills", "competencies", "expertise", "projects", "personal projects", "certifications", "certificates", "languages",
    "references", "achievements", "awards", "interests", "hobbies", "contact", "contacts", "personal details", "summary", "profile", "objective", "career objective", "about me",
]
QUALIFICATION = r"(?i)\b(?:ph\.?d|doctorate|doctoral|master(?:'s)?|m\.?sc|m\.?a|m\.?s|mba|m\.?phil|bachelor(?:'s)?|b\.?sc|b\.?a|b\.?s|bba|b\.?com|associate|diploma|higher secondary|secondary school|high school|intermediate|matric|foundation|certificate|certification|llb|jd|md|mbbs|bds|pharmd|engineering|computer science|information technology|data science|business administration|accounting|finance|economics|education|arts|commerce|science)\b"
INSTITUTION_WORD = r"(?i)\b(?:school|college|university|academy|institute|faculty|campus|polytechnic|department|board|centre|center)\b"
ACADEMIC_STATUS = r"(?i)^(?:completed|graduated|studied|pursuing|currently|major|specialization|specialised|specialized|coursework|thesis|cgpa|gpa)\b"
DEGREE_LINE = r"(?i)\b(?:matric(?:ulation)?|intermediate|f\.?sc|i\.?cs|bachelor|bachlor|masters?|b\.?\s*ed|m\.?\s*ed|b\.?\s*sc|m\.?\s*sc|b\.?\s*e|b\.?\s*tech|m\.?\s*tech|mba|ph\.?\s*d)\b"
EDUCATION_NOISE = [
    "classroom management", "lesson planning", "student communication", "subject knowledge", "communication skills", "teaching", "tutoring", "online teaching",
    "physics", "mathematics", "english", "urdu", "pushto", "present", "goals.",
]
STUDY_LINE = r"(?i)\b(?:matric(?:ulation)?|intermediate|fsc|fa|ics|icom|bachelor|b\.?s|b\.?sc|master|m\.?s|m\.?phil|msc|phd|doctorate|b\.?ed|m\.?ed|diploma)\b"
STUDY_HEADINGS = ["education", "academic background", "academic qualification", "qualifications", "qualification", "educational background"]
STUDY_ENDS = ["experience", "work experience", "employment", "projects", "certifications", "certificates", "skills", "languages", "contact", "contacts", "references"]

# Headings, words and phrases of jobs in resumes.
JOB_HEADINGS = [
    "experience", "work experience", "professional experience", "employment", "employment history", "employment experience", "career history", "work history",
    "professional background", "professional history", "career experience", "job experience", "work background", "internship", "internships", "internship experience",
    "industrial experience", "teaching experience", "relevant experience", "relevant work experience", "work experience and internships",
]
JOB_ENDS = [
    "education", "educational background", "academic background", "academic qualifications", "qualifications", "skills", "technical skills", "professional skills",
    "core skills", "key skills", "competencies", "expertise", "projects", "personal projects", "certifications", "certificates", "languages", "references",
    "achievements", "awards", "interests", "hobbies", "contact", "contacts", "personal details", "profile", "summary", "about me", "objective", "career objective",
]
JOB_TITLE = r"(?i)\b(?:developer|engineer|architect|analyst|scientist|programmer|designer|researcher|consultant|manager|supervisor|coordinator|administrator|assistant|officer|executive|director|lead|specialist|associate|intern|trainee|teacher|tutor|lecturer|professor|instructor|accountant|auditor|advisor|agent|representative|technician|nurse|doctor|pharmacist|lawyer|writer|editor|journalist|marketer|sales|operations|hr|human resources)\b"
JOB_ACTION = r"(?i)^(?:provided|managed|developed|created|designed|implemented|prepared|taught|trained|assisted|responsible|handled|worked|maintained|analyzed|supported|coordinated|supervised|conducted|delivered|performed|helped|monitored|explained|planned|organized|achieved|built|led|served|administered|researched|consulted|optimized|automated|deployed|contributed|collaborated|facilitated|mentored|executed|improved)\b"
ORGANISATION = r"(?i)\b(?:school|college|university|academy|institute|company|organization|corporation|hospital|bank|group|system|center|centre|agency|firm|solutions|technology|technologies|limited|ltd|llc|inc|studio|services|clinic|laboratory|lab|foundation|department|office|association)\b"
JOB_SPAN = r"(?i)\b(?:19|20)\d{2}\s*(?:-|–|—|to)\s*(?:(?:19|20)\d{2}|present)\b"
JOB_LABELS = [
    "experience", "professional experience", "work experience", "employment", "teaching experience", "professional background", "responsibilities", "responsibility", "duties", "job description",
]
JOB_STOPS = ["education", "skills", "projects", "certifications", "languages", "summary", "profile"]
SPILLED_PLACE = r"(?i),\s*(?:Peshawar|Swabi|Islamabad|Lahore|Karachi)\b"
NO_TITLES = ["strong - communication", "strong communication", "communication", "experience"]

# Projects and the prose of resumes.
PROJECT_HEADINGS = ["projects", "project", "academic projects", "personal projects", "major projects", "minor projects", "portfolio projects", "key projects"]
PROJECT_BEGINNINGS = ["ai-based ", "al-based ", "fraud detection", "fall detection", "resume parser", "document processing"]
PROSE_ENDS = ["teaching experience", "experience", "professional experience", "work experience"]
PERSONAL_DETAILS = ["personal details", "father name:", "date of birth:", "cnic:", "gender:", "religion:", "marital status:"]

# Labels that stand in forms without a colon, and beginnings of checkbox options.
KNOWN_LABELS = [
    "year covered", "brand family name", "variety description", "products length", "product length", "filter", "nonfilter", "hard pack", "soft pack", "menthol",
    "nonmenthol", "pack size sold", "tar", "nicotine", "variety unit sales", "variety dollar sales", "first sales date", "last sales date",
    "total reportable expenditures for variety", "bates id", "document copies", "page number(s)", "poor quality original",
    "overlay item could not be removed without damage to the original", "no documents were found within the original", "file folder", "redrope expandable file",
    "hanging file", "envelope", "other", "bates number", "not used", "other variance (explain)", "date", "description", "supplier", "total area budget",
    "current bal. available", "this change", "new balance", "committed to date", "submitted by", "approved by", "cc", "project no.", "account name", "project file",
    "internal init.", "ext. auth.", "final report due", "field complete", "total cost", "previous commitments", "amt. of change", "reasons", "wave(s)",
]
CHECKBOX_OPTIONS = [
    "document_copies_are_in_the_same_sequence", "page_number_s", "poor_quality_original", "overlay_item_could_not_be_removed",
    "no_documents_were_found_within_the_original", "file_folder", "redrope_expandable_file", "hanging_file", "envelope", "other_specify",
    "document_copies_were_reproduced", "bates_number", "not_used", "other_variance",
]
CHECKBOX_FIELDS = ["filter", "nonfilter", "hard_pack", "soft_pack", "menthol", "nonmenthol", "yes", "no", "male", "female", "checked", "selected"]

# Words of lines that are no product of an unheaded list.
NO_PRODUCT = ["TOTAL", "GST", "VAT", "AMOUNT", "DESCRIPTION", "PRICE", "QTY", "SUBTOTAL", "ROUND", "APPROVAL", "CARD", "THANK", "GOODS SOLD"]
