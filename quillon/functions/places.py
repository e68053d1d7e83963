"""Fixed values of places: countries, their cities, and the states of cities, in the order in which
a tie is settled. Every function that reads them takes another gazetteer as a parameter."""

# Active countries and the names of their cities.
CITIES = {
    "India": [
        "New Delhi", "Delhi", "Mumbai", "Kolkata", "Chennai", "Bengaluru", "Hyderabad", "Pune", "Srinagar", "Jammu",
        "Pulwama", "Pathankot", "Uri", "Amritsar", "Chandigarh", "Lucknow", "Patna", "Guwahati", "Imphal", "Anantnag",
        "Baramulla", "Kupwara", "Handwara", "Sopore", "Shopian", "Kulgam", "Bandipora", "Ganderbal", "Budgam", "Rajouri",
        "Poonch", "Kishtwar", "Nagrota", "Kathua", "Udhampur", "Reasi", "Doda", "Lethpora", "Awantipora", "Jalandhar",
        "Ludhiana", "Gurdaspur", "Dinanagar", "Bathinda", "Patiala", "Mohali", "Firozpur", "Faridkot", "Bodh Gaya", "Gaya",
        "Muzaffarpur", "Bhagalpur", "Kohima", "Dimapur", "Aizawl", "Shillong", "Agartala", "Itanagar", "Jaipur", "Ahmedabad",
        "Bhopal", "Indore", "Nagpur", "Varanasi", "Agra", "Kanpur", "Coimbatore",
    ],
    "Pakistan": [
        "Islamabad", "Rawalpindi", "Karachi", "Lahore", "Peshawar", "Quetta", "Multan", "Faisalabad", "Gujranwala", "Sialkot",
        "Abbottabad", "Muzaffarabad", "Mirpur", "Waziristan", "Swat", "Bannu", "Kohat", "Dera Ismail Khan", "Mardan", "Charsadda",
        "Nowshera", "Hangu", "Parachinar", "Turbat", "Gwadar", "Khuzdar", "Chaman", "Mastung", "Hub", "Naseerabad",
        "Jaffarabad", "Hyderabad", "Sukkur", "Larkana", "Nawabshah", "Sehwan", "Sargodha", "Jhang", "Bahawalpur", "Rahim Yar Khan",
        "Wagah",
    ],
    "China": [
        "Beijing", "Shanghai", "Guangzhou", "Shenzhen", "Chengdu", "Wuhan", "Lhasa", "Urumqi", "Kashgar", "Hotan",
    ],
    "Bangladesh": [
        "Dhaka", "Chittagong", "Khulna", "Sylhet", "Rajshahi", "Cox's Bazar", "Rangpur", "Comilla", "Gazipur", "Narayanganj",
    ],
    "Sri Lanka": [
        "Colombo", "Sri Jayawardenepura Kotte", "Kandy", "Galle", "Jaffna", "Trincomalee", "Batticaloa", "Negombo", "Matara", "Anuradhapura",
        "Polonnaruwa", "Kurunegala", "Hambantota", "Kilinochchi", "Mullaitivu", "Mannar",
    ],
    "Nepal": [
        "Kathmandu", "Pokhara", "Lalitpur", "Biratnagar", "Bharatpur",
    ],
    "Bhutan": [
        "Thimphu", "Phuntsholing", "Paro", "Punakha",
    ],
    "Myanmar": [
        "Naypyidaw", "Yangon", "Mandalay", "Bago", "Sittwe", "Myitkyina",
    ],
    "Afghanistan": [
        "Kabul", "Kandahar", "Herat", "Mazar-i-Sharif", "Jalalabad", "Kunduz", "Ghazni", "Lashkar Gah", "Tarin Kowt", "Gardez",
        "Khost", "Farah", "Pul-e-Khumri", "Mehtarlam", "Charikar", "Taloqan", "Faizabad", "Zaranj", "Sheberghan",
    ],
    "Maldives": [
        "Male", "Addu City", "Fuvahmulah",
    ],
}

# The state of a city, empty where none is in scope.
STATES = {
    "srinagar": "Jammu and Kashmir", "pulwama": "Jammu and Kashmir", "anantnag": "Jammu and Kashmir", "baramulla": "Jammu and Kashmir", "kupwara": "Jammu and Kashmir",
    "handwara": "Jammu and Kashmir", "sopore": "Jammu and Kashmir", "shopian": "Jammu and Kashmir", "kulgam": "Jammu and Kashmir", "bandipora": "Jammu and Kashmir",
    "ganderbal": "Jammu and Kashmir", "budgam": "Jammu and Kashmir", "rajouri": "Jammu and Kashmir", "poonch": "Jammu and Kashmir", "kishtwar": "Jammu and Kashmir",
    "nagrota": "Jammu and Kashmir", "kathua": "Jammu and Kashmir", "udhampur": "Jammu and Kashmir", "reasi": "Jammu and Kashmir", "doda": "Jammu and Kashmir",
    "lethpora": "Jammu and Kashmir", "awantipora": "Jammu and Kashmir", "uri": "Jammu and Kashmir", "jammu": "Jammu and Kashmir", "amritsar": "Punjab",
    "chandigarh": "Punjab", "pathankot": "Punjab", "jalandhar": "Punjab", "ludhiana": "Punjab", "gurdaspur": "Punjab",
    "dinanagar": "Punjab", "bathinda": "Punjab", "patiala": "Punjab", "mohali": "Punjab", "firozpur": "Punjab",
    "faridkot": "Punjab", "mumbai": "Maharashtra", "pune": "Maharashtra", "nagpur": "Maharashtra", "patna": "Bihar",
    "bodh gaya": "Bihar", "gaya": "Bihar", "muzaffarpur": "Bihar", "new delhi": "Delhi", "delhi": "Delhi",
    "kolkata": "West Bengal", "chennai": "Tamil Nadu", "bengaluru": "Karnataka", "hyderabad": "Telangana", "lucknow": "Uttar Pradesh",
    "varanasi": "Uttar Pradesh", "agra": "Uttar Pradesh", "kanpur": "Uttar Pradesh", "jaipur": "Rajasthan", "ahmedabad": "Gujarat",
    "bhopal": "Madhya Pradesh", "indore": "Madhya Pradesh", "guwahati": "Assam", "imphal": "Manipur", "kohima": "Nagaland",
    "coimbatore": "Tamil Nadu", "islamabad": "Islamabad Capital Territory", "rawalpindi": "Punjab", "lahore": "Punjab", "karachi": "Sindh",
    "peshawar": "Khyber Pakhtunkhwa", "quetta": "Balochistan", "abbottabad": "Khyber Pakhtunkhwa", "swat": "Khyber Pakhtunkhwa", "waziristan": "Khyber Pakhtunkhwa",
    "bannu": "Khyber Pakhtunkhwa", "turbat": "Balochistan", "gwadar": "Balochistan", "wagah": "Punjab", "kabul": "Kabul",
    "kandahar": "Kandahar", "herat": "Herat", "mazar-i-sharif": "Balkh", "jalalabad": "Nangarhar", "kunduz": "Kunduz",
    "ghazni": "Ghazni", "lashkar gah": "Helmand", "khost": "Khost", "gardez": "Paktia", "farah": "Farah",
    "taloqan": "Takhar", "faizabad": "Badakhshan", "sheberghan": "Jowzjan", "charikar": "Parwan", "dhaka": "Dhaka",
    "chittagong": "Chittagong", "sylhet": "Sylhet", "colombo": "", "negombo": "", "batticaloa": "",
    "jaffna": "", "trincomalee": "", "kandy": "", "galle": "",
}

# Names of states that are looked for in a text, in order.
STATE_NAMES = [
    "Jammu and Kashmir", "Khyber Pakhtunkhwa", "Balochistan", "North West Frontier Province", "Azad Kashmir", "Gilgit-Baltistan", "Federally Administered Tribal Areas",
    "Nangarhar", "Helmand", "Kandahar", "Balkh", "Sindh", "Punjab", "Bihar", "Maharashtra", "Tamil Nadu", "West Bengal", "Assam", "Karnataka", "Telangana",
    "Uttar Pradesh", "Rajasthan", "Gujarat", "Madhya Pradesh", "Manipur", "Nagaland",
]
