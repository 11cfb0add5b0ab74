"""Own wording of the generated text, one key -> sentence table per language.

``{name}`` marks a slot. A language may leave keys out: the lookup then falls back to English.
"""

WORDING = {
    "en": {
        "fit.Safe": "Comfortable: you rank ahead of the first seat given out last year.",
        "fit.Target": "Within reach: your rank sits inside last year's admitted window.",
        "fit.Reach": "A stretch: last year's final seat went to a slightly better rank.",
        "blurb.Target": "Closest to your rank, and so the most realistic choices.",
        "blurb.Reach": "Closed a little ahead of you; cutoffs move, so keep a few.",
        "blurb.Safe": "Reliable backups that opened behind your rank.",
        "brand.top_iit": "a leading IIT",
        "brand.iit": "an IIT",
        "brand.top_nit": "a leading NIT",
        "brand.nit": "an NIT",
        "brand.iiit": "an IIIT",
        "brand.gfti": "a centrally funded institute",
        "tail.high": "Its cutoff window is broad and steady.",
        "tail.medium": "Its cutoff window is of ordinary width.",
        "tail.fragile": "Its cutoff window is narrow and may shift.",
        "reason.lead": "{category} choice: {fit}, {branch} at {brand}",
        "reason.matched": "suits your goal well",
        "reason.unmatched": "worth keeping as an alternative",
        "reason.hs": "the home-state quota spares you about {n} ranks",
        "reason.female": "the women's pool closes about {n} ranks later",
        "reason.special": "the {quota} quota is open to you",
        "reason.join": ", and ",
        "note.no_adv": "Without a JEE Advanced rank no IIT can be listed.",
        "note.no_mains": "Without a JEE Main rank only IITs can be listed.",
        "note.category": "Category '{cat}' is not in this dataset, which holds OPEN seats.",
        "note.home_state": "Home state '{state}' is unknown, so home-state seats may be missing.",
        "note.branch_filter": "Limited to your preferred branches: {branches}.",
        "note.branch_filter_empty": "Nothing fits your preferred branches: {branches}.",
        "guidance.empty": "No option fits this profile; check the ranks or widen the filters.",
        "guidance.found": "{total} options fit this profile and {shown} are listed.",
        "goal.coding": "Computing branches are listed first for a software career.",
        "goal.research": "Science and mathematics branches are listed first for research.",
        "goal.mba": "Economics and quantitative branches are listed first for management.",
        "goal.core": "Classical engineering branches are listed first for a core career.",
        "goal.undecided": "Versatile branches are listed first to keep your options open.",
        "pref.cs_it": "Computer Science / IT",
        "pref.ece": "Electronics & Communication",
        "pref.ee": "Electrical",
        "pref.math_computing": "Mathematics & Computing",
        "pref.ai_ds": "AI & Data Science",
        "pref.mechanical": "Mechanical",
        "pref.civil": "Civil",
        "pref.chemical": "Chemical",
        "quota.AI": "All-India",
        "quota.HS": "Home state",
        "quota.OS": "Other state",
        "quota.GO": "Goa",
        "quota.JK": "Jammu & Kashmir",
        "quota.LA": "Ladakh",
        "headline.adjust": "Let us adjust the search.",
        "headline.good": "You are well placed.",
        "headline.options": "You have realistic options.",
        "headline.solid": "You have dependable backups.",
        "headline.stretch": "Ambitious, yet possible.",
        "share.title": "My admission matches",
        "share.target": "{count} Target options, among them {picks}",
        "share.picks": "Best matches: {picks}",
        "share.counts": "{safe} Safe and {reach} Reach options",
    },
    "hi": {
        "fit.Safe": "आरामदायक: आपकी रैंक पिछले वर्ष की पहली सीट से आगे है।",
        "fit.Target": "पहुँच में: आपकी रैंक पिछले वर्ष की सीमा के भीतर है।",
        "fit.Reach": "कठिन: पिछले वर्ष की अंतिम सीट थोड़ी बेहतर रैंक पर गई।",
        "blurb.Target": "आपकी रैंक के सबसे निकट, इसलिए सबसे व्यावहारिक।",
        "blurb.Reach": "आपसे थोड़ा पहले बंद हुए; कुछ विकल्प रखें।",
        "blurb.Safe": "भरोसेमंद विकल्प जो आपकी रैंक के बाद खुले।",
        "brand.top_iit": "अग्रणी IIT",
        "brand.iit": "IIT",
        "brand.top_nit": "अग्रणी NIT",
        "brand.nit": "NIT",
        "brand.iiit": "IIIT",
        "brand.gfti": "केंद्र-पोषित संस्थान",
        "tail.high": "कटऑफ़ सीमा चौड़ी और स्थिर है।",
        "tail.medium": "कटऑफ़ सीमा सामान्य है।",
        "tail.fragile": "कटऑफ़ सीमा संकरी है और बदल सकती है।",
        "reason.lead": "{category} विकल्प: {fit}, {brand} में {branch}",
        "reason.matched": "आपके लक्ष्य के अनुकूल",
        "reason.unmatched": "दूसरे विकल्प के रूप में रखने योग्य",
        "reason.hs": "गृह-राज्य कोटे से लगभग {n} रैंक का लाभ",
        "reason.female": "महिला सीट लगभग {n} रैंक बाद बंद होती है",
        "reason.special": "{quota} कोटा आपके लिए खुला है",
        "reason.join": ", और ",
        "note.no_adv": "JEE Advanced रैंक के बिना IIT नहीं दिख सकते।",
        "note.no_mains": "JEE Main रैंक के बिना केवल IIT दिख सकते हैं।",
        "note.category": "श्रेणी '{cat}' इस डेटा में नहीं है; केवल OPEN सीटें हैं।",
        "note.home_state": "गृह राज्य '{state}' अज्ञात है; गृह-राज्य सीटें छूट सकती हैं।",
        "note.branch_filter": "केवल पसंदीदा शाखाएँ: {branches}।",
        "note.branch_filter_empty": "पसंदीदा शाखाओं में कुछ नहीं मिला: {branches}।",
        "guidance.empty": "कोई विकल्प नहीं मिला; रैंक या फ़िल्टर जाँचें।",
        "guidance.found": "{total} विकल्प मिले, {shown} दिखाए गए।",
        "goal.coding": "सॉफ़्टवेयर करियर के लिए कंप्यूटिंग शाखाएँ पहले हैं।",
        "goal.research": "शोध के लिए विज्ञान और गणित शाखाएँ पहले हैं।",
        "goal.mba": "प्रबंधन के लिए अर्थशास्त्र और गणनात्मक शाखाएँ पहले हैं।",
        "goal.core": "कोर करियर के लिए मूल इंजीनियरिंग शाखाएँ पहले हैं।",
        "goal.undecided": "विकल्प खुले रखने के लिए बहुमुखी शाखाएँ पहले हैं।",
        "pref.cs_it": "कंप्यूटर साइंस / IT",
        "pref.ece": "इलेक्ट्रॉनिक्स",
        "pref.ee": "इलेक्ट्रिकल",
        "pref.math_computing": "गणित और कंप्यूटिंग",
        "pref.ai_ds": "AI और डेटा साइंस",
        "pref.mechanical": "मैकेनिकल",
        "pref.civil": "सिविल",
        "pref.chemical": "केमिकल",
        "quota.AI": "अखिल भारतीय",
        "quota.HS": "गृह राज्य",
        "quota.OS": "अन्य राज्य",
        "quota.GO": "गोवा",
        "quota.JK": "जम्मू-कश्मीर",
        "quota.LA": "लद्दाख",
        "headline.adjust": "खोज में बदलाव करें।",
        "headline.good": "आपकी स्थिति अच्छी है।",
        "headline.options": "आपके पास व्यावहारिक विकल्प हैं।",
        "headline.solid": "आपके पास भरोसेमंद विकल्प हैं।",
        "headline.stretch": "कठिन है, पर संभव।",
        "share.title": "मेरे प्रवेश विकल्प",
        "share.target": "{count} Target विकल्प, जैसे {picks}",
        "share.picks": "सर्वोत्तम विकल्प: {picks}",
        "share.counts": "{safe} Safe और {reach} Reach विकल्प",
    },
    "gu": {
        "fit.Safe": "આરામદાયક: તમારો રેન્ક ગયા વર્ષની પહેલી સીટથી આગળ છે.",
        "fit.Target": "પહોંચમાં: તમારો રેન્ક ગયા વર્ષની મર્યાદાની અંદર છે.",
        "fit.Reach": "મુશ્કેલ: ગયા વર્ષની છેલ્લી સીટ થોડા સારા રેન્કે ગઈ.",
        "blurb.Target": "તમારા રેન્કની સૌથી નજીક, તેથી સૌથી વ્યવહારુ.",
        "blurb.Reach": "તમારાથી થોડા પહેલાં બંધ થયા; થોડા રાખો.",
        "blurb.Safe": "ભરોસાપાત્ર વિકલ્પો.",
        "brand.top_iit": "અગ્રણી IIT",
        "brand.iit": "IIT",
        "brand.top_nit": "અગ્રણી NIT",
        "brand.nit": "NIT",
        "brand.iiit": "IIIT",
        "brand.gfti": "કેન્દ્ર-પોષિત સંસ્થા",
        "tail.high": "કટઓફ મર્યાદા પહોળી અને સ્થિર છે.",
        "tail.medium": "કટઓફ મર્યાદા સામાન્ય છે.",
        "tail.fragile": "કટઓફ મર્યાદા સાંકડી છે અને બદલાઈ શકે છે.",
        "reason.lead": "{category} વિકલ્પ: {fit}, {brand} માં {branch}",
        "reason.matched": "તમારા લક્ષ્યને અનુકૂળ",
        "reason.unmatched": "બીજા વિકલ્પ તરીકે રાખવા જેવો",
        "reason.hs": "ગૃહ-રાજ્ય ક્વોટાથી આશરે {n} રેન્કનો લાભ",
        "reason.female": "મહિલા સીટ આશરે {n} રેન્ક પછી બંધ થાય છે",
        "reason.special": "{quota} ક્વોટા તમારા માટે ખુલ્લો છે",
        "reason.join": ", અને ",
        "note.no_adv": "JEE Advanced રેન્ક વિના IIT દેખાતી નથી.",
        "note.no_mains": "JEE Main રેન્ક વિના ફક્ત IIT દેખાય છે.",
        "note.category": "શ્રેણી '{cat}' આ ડેટામાં નથી; ફક્ત OPEN સીટો છે.",
        "note.home_state": "ગૃહ રાજ્ય '{state}' અજાણ્યું છે; ગૃહ-રાજ્ય સીટો છૂટી શકે.",
        "note.branch_filter": "ફક્ત પસંદગીની શાખાઓ: {branches}.",
        "note.branch_filter_empty": "પસંદગીની શાખાઓમાં કંઈ મળ્યું નથી: {branches}.",
        "guidance.empty": "કોઈ વિકલ્પ મળ્યો નથી; રેન્ક અથવા ફિલ્ટર તપાસો.",
        "guidance.found": "{total} વિકલ્પ મળ્યા, {shown} બતાવ્યા છે.",
        "goal.coding": "સોફ્ટવેર કારકિર્દી માટે કમ્પ્યુટિંગ શાખાઓ પહેલા છે.",
        "goal.research": "સંશોધન માટે વિજ્ઞાન અને ગણિત શાખાઓ પહેલા છે.",
        "goal.mba": "મેનેજમેન્ટ માટે અર્થશાસ્ત્રની શાખાઓ પહેલા છે.",
        "goal.core": "કોર કારકિર્દી માટે મૂળ ઇજનેરી શાખાઓ પહેલા છે.",
        "goal.undecided": "વિકલ્પો ખુલ્લા રાખવા બહુમુખી શાખાઓ પહેલા છે.",
        "pref.cs_it": "કમ્પ્યુટર સાયન્સ / IT",
        "pref.ece": "ઇલેક્ટ્રોનિક્સ",
        "pref.ee": "ઇલેક્ટ્રિકલ",
        "pref.math_computing": "ગણિત અને કમ્પ્યુટિંગ",
        "pref.ai_ds": "AI અને ડેટા સાયન્સ",
        "pref.mechanical": "મિકેનિકલ",
        "pref.civil": "સિવિલ",
        "pref.chemical": "કેમિકલ",
        "quota.AI": "અખિલ ભારતીય",
        "quota.HS": "ગૃહ રાજ્ય",
        "quota.OS": "અન્ય રાજ્ય",
        "quota.GO": "ગોવા",
        "quota.JK": "જમ્મુ-કાશ્મીર",
        "quota.LA": "લદ્દાખ",
        "headline.adjust": "શોધમાં ફેરફાર કરો.",
        "headline.good": "તમારી સ્થિતિ સારી છે.",
        "headline.options": "તમારી પાસે વ્યવહારુ વિકલ્પો છે.",
        "headline.solid": "તમારી પાસે ભરોસાપાત્ર વિકલ્પો છે.",
        "headline.stretch": "મુશ્કેલ, પણ શક્ય.",
    },
    "kn": {
        "fit.Safe": "ಆರಾಮದಾಯಕ: ನಿಮ್ಮ ರ್‍ಯಾಂಕ್ ಕಳೆದ ವರ್ಷದ ಮೊದಲ ಸೀಟಿಗಿಂತ ಮುಂದಿದೆ.",
        "fit.Target": "ಕೈಗೆಟುಕುವ: ನಿಮ್ಮ ರ್‍ಯಾಂಕ್ ಕಳೆದ ವರ್ಷದ ಮಿತಿಯೊಳಗಿದೆ.",
        "fit.Reach": "ಕಷ್ಟ: ಕಳೆದ ವರ್ಷದ ಕೊನೆಯ ಸೀಟು ಸ್ವಲ್ಪ ಉತ್ತಮ ರ್‍ಯಾಂಕ್‌ಗೆ ಹೋಯಿತು.",
        "blurb.Target": "ನಿಮ್ಮ ರ್‍ಯಾಂಕ್‌ಗೆ ಅತ್ಯಂತ ಹತ್ತಿರದ ಆಯ್ಕೆಗಳು.",
        "blurb.Reach": "ನಿಮಗಿಂತ ಸ್ವಲ್ಪ ಮೊದಲು ಮುಚ್ಚಿದವು; ಕೆಲವನ್ನು ಇರಿಸಿ.",
        "blurb.Safe": "ನಂಬಿಕಾರ್ಹ ಪರ್ಯಾಯಗಳು.",
        "brand.top_iit": "ಮುಂಚೂಣಿಯ IIT",
        "brand.iit": "IIT",
        "brand.top_nit": "ಮುಂಚೂಣಿಯ NIT",
        "brand.nit": "NIT",
        "brand.iiit": "IIIT",
        "brand.gfti": "ಕೇಂದ್ರ ಅನುದಾನಿತ ಸಂಸ್ಥೆ",
        "tail.high": "ಕಟ್‌ಆಫ್ ಮಿತಿ ವಿಶಾಲ ಮತ್ತು ಸ್ಥಿರ.",
        "tail.medium": "ಕಟ್‌ಆಫ್ ಮಿತಿ ಸಾಮಾನ್ಯ.",
        "tail.fragile": "ಕಟ್‌ಆಫ್ ಮಿತಿ ಕಿರಿದು, ಬದಲಾಗಬಹುದು.",
        "reason.lead": "{category} ಆಯ್ಕೆ: {fit}, {brand} ನಲ್ಲಿ {branch}",
        "reason.matched": "ನೀವು ಆರಿಸಿದ ದಾರಿಗೆ ನೆರವಾಗುತ್ತದೆ",
        "reason.unmatched": "ಪರ್ಯಾಯವಾಗಿ ಇರಿಸಬಹುದು",
        "reason.hs": "ತವರು ರಾಜ್ಯ ಕೋಟಾದಿಂದ ಸುಮಾರು {n} ರ್‍ಯಾಂಕ್ ಲಾಭ",
        "reason.female": "ಮಹಿಳಾ ಸೀಟು ಸುಮಾರು {n} ರ್‍ಯಾಂಕ್ ನಂತರ ಮುಚ್ಚುತ್ತದೆ",
        "reason.special": "{quota} ಕೋಟಾ ನಿಮಗೆ ತೆರೆದಿದೆ",
        "reason.join": ", ಮತ್ತು ",
        "note.no_adv": "JEE Advanced ರ್‍ಯಾಂಕ್ ಇಲ್ಲದೆ IIT ಕಾಣಿಸುವುದಿಲ್ಲ.",
        "note.no_mains": "JEE Main ರ್‍ಯಾಂಕ್ ಇಲ್ಲದೆ IIT ಮಾತ್ರ ಕಾಣಿಸುತ್ತವೆ.",
        "note.category": "ವರ್ಗ '{cat}' ಈ ದತ್ತಾಂಶದಲ್ಲಿ ಇಲ್ಲ; OPEN ಸೀಟುಗಳು ಮಾತ್ರ.",
        "note.home_state": "ತವರು ರಾಜ್ಯ '{state}' ಗೊತ್ತಿಲ್ಲ; ಕೆಲವು ಸೀಟುಗಳು ತಪ್ಪಬಹುದು.",
        "note.branch_filter": "ನಿಮ್ಮ ಇಷ್ಟದ ವಿಭಾಗಗಳು ಮಾತ್ರ: {branches}.",
        "note.branch_filter_empty": "ಇಷ್ಟದ ವಿಭಾಗಗಳಲ್ಲಿ ಏನೂ ಸಿಗಲಿಲ್ಲ: {branches}.",
        "guidance.empty": "ಯಾವ ಆಯ್ಕೆಯೂ ಸಿಗಲಿಲ್ಲ; ರ್‍ಯಾಂಕ್ ಅಥವಾ ಫಿಲ್ಟರ್ ಪರಿಶೀಲಿಸಿ.",
        "guidance.found": "{total} ಆಯ್ಕೆಗಳು ಸಿಕ್ಕಿವೆ, {shown} ತೋರಿಸಲಾಗಿದೆ.",
        "goal.coding": "ಸಾಫ್ಟ್‌ವೇರ್ ವೃತ್ತಿಗೆ ಕಂಪ್ಯೂಟಿಂಗ್ ವಿಭಾಗಗಳು ಮೊದಲು.",
        "goal.research": "ಸಂಶೋಧನೆಗೆ ವಿಜ್ಞಾನ ಮತ್ತು ಗಣಿತ ವಿಭಾಗಗಳು ಮೊದಲು.",
        "goal.mba": "ನಿರ್ವಹಣೆಗೆ ಅರ್ಥಶಾಸ್ತ್ರ ವಿಭಾಗಗಳು ಮೊದಲು.",
        "goal.core": "ಕೋರ್ ವೃತ್ತಿಗೆ ಮೂಲ ಇಂಜಿನಿಯರಿಂಗ್ ವಿಭಾಗಗಳು ಮೊದಲು.",
        "goal.undecided": "ಆಯ್ಕೆಗಳನ್ನು ತೆರೆದಿಡಲು ಬಹುಮುಖ ವಿಭಾಗಗಳು ಮೊದಲು.",
        "pref.cs_it": "ಕಂಪ್ಯೂಟರ್ ಸೈನ್ಸ್ / IT",
        "pref.ece": "ಎಲೆಕ್ಟ್ರಾನಿಕ್ಸ್",
        "pref.ee": "ಎಲೆಕ್ಟ್ರಿಕಲ್",
        "pref.math_computing": "ಗಣಿತ ಮತ್ತು ಕಂಪ್ಯೂಟಿಂಗ್",
        "pref.ai_ds": "AI ಮತ್ತು ಡೇಟಾ ಸೈನ್ಸ್",
        "pref.mechanical": "ಮೆಕ್ಯಾನಿಕಲ್",
        "pref.civil": "ಸಿವಿಲ್",
        "pref.chemical": "ಕೆಮಿಕಲ್",
        "quota.AI": "ಅಖಿಲ ಭಾರತ",
        "quota.HS": "ತವರು ರಾಜ್ಯ",
        "quota.OS": "ಇತರ ರಾಜ್ಯ",
        "quota.GO": "ಗೋವಾ",
        "quota.JK": "ಜಮ್ಮು-ಕಾಶ್ಮೀರ",
        "quota.LA": "ಲಡಾಖ್",
        "headline.adjust": "ಹುಡುಕಾಟ ಬದಲಿಸಿ.",
        "headline.good": "ನಿಮ್ಮ ಸ್ಥಿತಿ ಚೆನ್ನಾಗಿದೆ.",
        "headline.options": "ನಿಮಗೆ ನೈಜ ಆಯ್ಕೆಗಳಿವೆ.",
        "headline.solid": "ನಿಮಗೆ ನಂಬಿಕಾರ್ಹ ಪರ್ಯಾಯಗಳಿವೆ.",
        "headline.stretch": "ಕಷ್ಟ, ಆದರೆ ಸಾಧ್ಯ.",
    },
}

# labels of form options
GOAL_LABELS = {
    "coding": "A job writing software",
    "research": "Postgraduate study or research",
    "mba": "Business and management",
    "core": "Working in a classic engineering field",
    "undecided": "Not settled yet",
}
SEAT_LABELS = {
    "OPEN": "Open to all",
    "OBC-NCL": "Other Backward Classes, non-creamy layer",
    "SC": "Scheduled Castes",
    "ST": "Scheduled Tribes",
    "EWS": "Low-income general group",
    "PwD": "Persons with disabilities",
}
