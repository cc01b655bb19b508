"""Sentences with marked personal information that share neither context nor name with the labelled table; pieces stand in ⟦kind|text⟧."""

HELD_OUT = """
The refund landed after ⟦person|Tobias Lindqvist⟧ phoned the bank.
Room keys were handed over by ⟦person|Priyantha Weerakoon⟧, the concierge.
Complaint filed by Mr. ⟦person|Declan Murphy⟧ on Tuesday.
Mrs ⟦person|Adaeze Okafor⟧ runs the breakfast counter with her daughter.
Our trekking leader ⟦person|Bhanu Rathore⟧ carried spare water.
I would recommend ⟦person|Shehan Fonseka⟧ as a chauffeur.
Dr. ⟦person|Mireille Fontaine⟧ stitched my knee the same evening.
The bride, ⟦person|Tharanga Silva⟧, rented the whole terrace.
Reservation name: ⟦person|KOWALSKI, Agnieszka⟧
Speak with ⟦person|R. Muthukumar⟧ if the gate is locked.
Warm greetings, ⟦person|Eleni Papadaki⟧
Ms ⟦person|J. Abernathy⟧ lost a purse here.
Our babysitter was ⟦person|Dinusha P. Alwis⟧, very gentle.
Prof. ⟦person|Gunnar Eriksson⟧ lectured on turtles.
We owe it all to ⟦person|Chaminda Rodrigo⟧.
The plumber, ⟦person|Asanka Peiris⟧, arrived within minutes.
Frau ⟦person|Annelise Vogt⟧ sprach mit dem Koch.
Notre chauffeur, ⟦person|Mathieu Garnier⟧, était ponctuel.
Questions go to ⟦email|reservations@cliffedge-inn.lk⟧ before noon.
My new inbox is ⟦email|t.lindqvist84@posteo.se⟧, thanks.
Kindly drop ⟦email|dilshan_r@hillview.lk⟧ a line.
Photos were shared with ⟦email|okafor.family@outlook.com⟧ yesterday.
The accountant replied from ⟦email|accounts+2024@surfcamp.co.uk⟧.
If the form fails, try ⟦email|helpdesk [at] baystay [dot] com⟧ instead.
Spam keeps coming from ⟦email|PROMO@CHEAPROOMS.BIZ⟧!
Reachable under ⟦email|vogt (at) wanderlust.de⟧ at weekends.
Lost property: ⟦email|found.items@airport.example.org⟧
Schreiben Sie bitte an ⟦email|kontakt@seeblick-pension.de⟧.
Reception picks up on ⟦phone|+94 77 845 2210⟧ until midnight.
The doctor on duty has ⟦phone|011 258 6633⟧.
For the tuk-tuk use ⟦phone|0714567890⟧ (Sunil bargains).
Emergency contact: ⟦phone|+44 7911 123456⟧
I left three voicemails at ⟦phone|(081) 222-4455⟧.
The agency in Boston is ⟦phone|617-555-0142⟧.
My landline, ⟦phone|0112 345 678⟧, never works in the rain.
Unsere Nummer lautet ⟦phone|+49 30 901820⟧.
Joignable au ⟦phone|06 12 34 56 78⟧ le soir.
Numbers on the door: ⟦phone|0094 71 334 5566⟧ and ⟦phone|038-2299110⟧
The clerk photographed my NIC (⟦national_id|886541230V⟧) without asking.
Why print ⟦national_id|199534501234⟧, my identity number, on a receipt?
A passport, ⟦national_id|N5520117⟧, was found in the sauna.
Her passport, ⟦national_id|PA4478120⟧, expired in transit.
Driver's NIC was ⟦national_id|751234567X⟧, I checked.
Social security ⟦national_id|078-05-1120⟧ appeared on the fax.
National ID ⟦national_id|2001 3340 5567⟧ belongs to my nephew.
The police asked for my passport number and I gave ⟦national_id|K8830212⟧.
Identity card of the victim: ⟦national_id|903312211v⟧
Personalausweis ⟦national_id|L22N5K9T34⟧ wurde kopiert.
The courier dropped it at ⟦address|47 Flower Road⟧, Colombo 7.
Grandmother's bungalow stands at ⟦address|12/3 Temple Lane⟧, Kandy.
Our villa is No. ⟦address|31/7 Samudra Mawatha⟧, Mount Lavinia.
I grew up at ⟦address|8 Marine Drive⟧ and miss the trains.
Collect the surfboard from ⟦address|221B Baker Street⟧ please.
Invoice address ⟦address|305, Hill Street⟧, Dehiwala.
The dentist practises at ⟦address|Lindenallee 14⟧, Bremen.
Drop me at No. ⟦address|66 Station Rd⟧, Matara.
He was born at ⟦address|19A Church Avenue⟧, Negombo, in 1961.
Register the scooter under ⟦address|Galle Face Terrace 5⟧, second floor.
Unser Ferienhaus: ⟦address|7 Lagoon Gardens⟧, Bentota.
The office of the notary is ⟦address|150/2 Park Street⟧.
The Cinnamon Crest Hotel charges 14,500 a night.
Galle Fort and Flag Rock are best at dawn.
Train 1045 leaves Platform 3 at 06:55.
Marine Drive floods every May.
Confirmation HX-77219 arrived within minutes.
Lake Gregory, Gregory Park and Victoria Park all open at 7.
Follow @lagoonlife for tide tables.
The Ceylon Tea Museum sells 250 g packs for Rs. 1,850.
Between 2019 and 2023 visitor numbers rose by 1,204,556.
Seventh Heaven Guest House has 12 rooms and 3 suites.
The Southern Expressway was closed for 45 minutes near Kurundugahahetekma.
Coordinates 6.92710, 79.86120 point to the harbour.
Tickets cost 30 USD; gate 4/5 is nearest.
Ministry of Tourism staff inspected Coral Gardens Resort on 12 March.
"""
