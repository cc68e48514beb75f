"""Word lists for synthetic people and places, Latin script and Devanagari side by side."""

# Fixed values, chosen for this package: given names, family names, parts of addresses.
GIVEN = (
    ("Abhay", "अभय"), ("Ajay", "अजय"), ("Akash", "आकाश"), ("Alok", "आलोक"), ("Anand", "आनंद"),
    ("Anil", "अनिल"), ("Arun", "अरुण"), ("Ashok", "अशोक"), ("Bharat", "भरत"), ("Chetan", "चेतन"),
    ("Dinesh", "दिनेश"), ("Gaurav", "गौरव"), ("Girish", "गिरीश"), ("Gopal", "गोपाल"), ("Hemant", "हेमंत"),
    ("Jagdish", "जगदीश"), ("Jatin", "जतिन"), ("Kamal", "कमल"), ("Lalit", "ललित"), ("Mahesh", "महेश"),
    ("Mohan", "मोहन"), ("Naveen", "नवीन"), ("Omkar", "ओंकार"), ("Pankaj", "पंकज"), ("Prakash", "प्रकाश"),
    ("Ravi", "रवि"), ("Sachin", "सचिन"), ("Salim", "सलीम"), ("Sunil", "सुनील"), ("Tarun", "तरुण"),
    ("Uday", "उदय"), ("Vinod", "विनोद"), ("Yusuf", "यूसुफ"), ("Aarti", "आरती"), ("Asha", "आशा"),
    ("Bhavna", "भावना"), ("Chitra", "चित्रा"), ("Gauri", "गौरी"), ("Hema", "हेमा"), ("Jyoti", "ज्योति"),
    ("Kamala", "कमला"), ("Lata", "लता"), ("Madhuri", "माधुरी"), ("Nisha", "निशा"), ("Padma", "पद्मा"),
    ("Rekha", "रेखा"), ("Shabana", "शबाना"), ("Teresa", "टेरेसा"), ("Usha", "उषा"), ("Vidya", "विद्या"),
)
FAMILY = (
    ("Acharya", "आचार्य"), ("Ahuja", "आहूजा"), ("Apte", "आप्टे"), ("Arora", "अरोड़ा"), ("Bajaj", "बजाज"),
    ("Bhatia", "भाटिया"), ("Bose", "बोस"), ("Chandra", "चंद्र"), ("Chopra", "चोपड़ा"), ("Dave", "दवे"),
    ("D'Mello", "डिमेलो"), ("Dubey", "दुबे"), ("Dutta", "दत्ता"), ("Gandhi", "गांधी"), ("Garg", "गर्ग"),
    ("Ghosh", "घोष"), ("Gokhale", "गोखले"), ("Hegde", "हेगड़े"), ("Hussain", "हुसैन"), ("Kamath", "कामत"),
    ("Kapoor", "कपूर"), ("Khanna", "खन्ना"), ("Lal", "लाल"), ("Malhotra", "मल्होत्रा"), ("Mathur", "माथुर"),
    ("Mohanty", "मोहंती"), ("Nanda", "नंदा"), ("Ojha", "ओझा"), ("Pawar", "पवार"), ("Prasad", "प्रसाद"),
    ("Rajput", "राजपूत"), ("Rane", "राणे"), ("Roy", "रॉय"), ("Sethi", "सेठी"), ("Shetty", "शेट्टी"),
    ("Sinha", "सिन्हा"), ("Sodhi", "सोढ़ी"), ("Thakur", "ठाकुर"), ("Trivedi", "त्रिवेदी"), ("Vaidya", "वैद्य"),
)
LOCALITIES = (
    ("Tilak Road", "तिलक रोड"), ("Nehru Nagar", "नेहरू नगर"), ("Lake View", "लेक व्यू"), ("Gandhi Path", "गांधी पथ"),
    ("Sector 9", "सेक्टर 9"), ("Railway Colony", "रेलवे कॉलोनी"), ("Saket Nagar", "साकेत नगर"),
    ("New Market", "न्यू मार्केट"), ("Vijay Nagar", "विजय नगर"), ("Temple Street", "टेंपल स्ट्रीट"),
    ("Anand Vihar", "आनंद विहार"), ("Kamla Park", "कमला पार्क"),
)
BUILDINGS = (
    ("Ashirwad Towers", "आशीर्वाद टावर्स"), ("Sunrise Apartments", "सनराइज अपार्टमेंट"), ("Gokul Dham", "गोकुल धाम"),
    ("Pearl Residency", "पर्ल रेजीडेंसी"), ("Himalaya House", "हिमालय हाउस"), ("Sagar Kunj", "सागर कुंज"),
)
LANDMARKS = (
    ("Shiv Mandir", "शिव मंदिर"), ("District Court", "जिला न्यायालय"), ("Railway Station", "रेलवे स्टेशन"),
    ("Water Tank", "पानी की टंकी"), ("Girls School", "कन्या विद्यालय"),
)
CITIES = (
    # city, state, first three digits of the PIN code
    ("Thane", "ठाणे", "Maharashtra", "महाराष्ट्र", "400"), ("Nashik", "नासिक", "Maharashtra", "महाराष्ट्र", "422"),
    ("Gurugram", "गुरुग्राम", "Haryana", "हरियाणा", "122"), ("Mysuru", "मैसूरु", "Karnataka", "कर्नाटक", "570"),
    ("Mangaluru", "मंगलुरु", "Karnataka", "कर्नाटक", "575"), ("Madurai", "मदुरै", "Tamil Nadu", "तमिलनाडु", "625"),
    ("Warangal", "वारंगल", "Telangana", "तेलंगाना", "506"), ("Howrah", "हावड़ा", "West Bengal", "पश्चिम बंगाल", "711"),
    ("Surat", "सूरत", "Gujarat", "गुजरात", "395"), ("Udaipur", "उदयपुर", "Rajasthan", "राजस्थान", "313"),
    ("Kanpur", "कानपुर", "Uttar Pradesh", "उत्तर प्रदेश", "208"), ("Agra", "आगरा", "Uttar Pradesh", "उत्तर प्रदेश", "282"),
    ("Gaya", "गया", "Bihar", "बिहार", "823"), ("Gwalior", "ग्वालियर", "Madhya Pradesh", "मध्य प्रदेश", "474"),
    ("Thrissur", "त्रिशूर", "Kerala", "केरल", "680"), ("Ludhiana", "लुधियाना", "Punjab", "पंजाब", "141"),
    ("Ranchi", "रांची", "Jharkhand", "झारखंड", "834"),
)
NAMED_PLACES = (
    # Named after people, yet not personal data.
    "Ambedkar Stadium", "Azad Maidan", "Bhagat Singh Chowk", "Gokhale Road", "Jamshedji Tata Hall", "Kamaraj Avenue",
    "Lajpat Nagar", "Mahatma Gandhi Road", "Netaji Bhavan", "Ramanujan Institute", "Tagore Theatre", "Vivekananda Setu",
)
MONTHS = (
    ("January", "जनवरी"), ("February", "फ़रवरी"), ("March", "मार्च"), ("April", "अप्रैल"), ("May", "मई"), ("June", "जून"),
    ("July", "जुलाई"), ("August", "अगस्त"), ("September", "सितंबर"), ("October", "अक्टूबर"), ("November", "नवंबर"),
    ("December", "दिसंबर"),
)
# Public codes and names, chosen for this package.
BANKS = ("ANDB", "AUBL", "CIUB", "DBSS", "ESFB", "IBKL", "KVBL", "MAHB", "RATN", "SIBL", "TMBL", "UCBA")
UPI_HANDLES = ("aubank", "barodampay", "federal", "freecharge", "idfcbank", "indus", "kotak", "sbi", "upi", "yesbank")
EMAIL_DOMAINS = ("example.com", "example.org", "fastmail.com", "mail.example.net", "post.example.in", "proton.me", "zoho.in")
SERVICE_ACCOUNTS = ("www@web-03", "spool@print-hall", "cron@nightly", "ntp@clock-a", "relay@edge-2", "scan@warehouse")
BRANCH_CHARS = "0123456789ACEFHJKMNPRTUVWXY"
CARD_PREFIXES = ("2720", "35", "40", "43", "53", "55", "62", "6521")
VEHICLE_STATES = ("AS", "CG", "CH", "GA", "HP", "JH", "JK", "KA", "MH", "NL", "OD", "PY", "SK", "TR", "UK")
