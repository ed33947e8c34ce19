"""Expectations: names, one entry each in alphabetical order, with what a parser must read in them; lists are joined by bars."""

from __future__ import annotations

# ---- Fixed values: inputs and the fields that are looked at. ----
CASES = (
    ("Abarema clypearia (Jack) Kosterm., P. P.", {"genus": "Abarema", "sp": "clypearia", "rank": "SPECIES", "comb": "Kosterm.", "bas": "Jack"}),
    ("Abida secale margaridae I.M.Fake Ms", {"genus": "Abida", "sp": "secale", "isp": "margaridae", "rank": "INFRASPECIFIC_NAME", "comb": "I.M.Fake"}),
    ("Abramis Cuvier 1816 sec. Dybowski 1862", {"uni": "Abramis", "comb": "Cuvier", "year": "1816", "tax": "sec. Dybowski 1862", "code": "ZOOLOGICAL"}),
    ("Abramis brama subsp. bergi Grib & Vernidub 1935 sec Eschmeyer 2004", {"genus": "Abramis", "sp": "brama", "isp": "bergi", "rank": "SUBSPECIES", "comb": "Grib|Vernidub", "year": "1935", "tax": "sec Eschmeyer 2004", "code": "ZOOLOGICAL"}),
    ("Abrodictyum caespifrons (C. Chr.) comb. ined.", {"genus": "Abrodictyum", "sp": "caespifrons", "rank": "SPECIES", "bas": "C.Chr.", "nom": "comb. ined.", "code": "ZOOLOGICAL"}),
    ("Abryna -petri Paiva, 1860", {"uni": "Abryna", "comb": "petri Paiva", "year": "1860"}),
    ("Abryna petri- Paiva, 1860", {"genus": "Abryna", "sp": "petri", "rank": "SPECIES", "comb": "Paiva", "year": "1860"}),
    ("Acarospora cratericola cratericola Shenk 1974 group", {"genus": "Acarospora", "sp": "cratericola", "isp": "cratericola", "rank": "SUBSPECIES", "comb": "Shenk", "year": "1974"}),
    ("Acarospora cratericola cratericola Shenk 1974 species complex", {"genus": "Acarospora", "sp": "cratericola", "isp": "cratericola", "rank": "SUBSPECIES", "comb": "Shenk", "year": "1974"}),
    ("Acarospora cratericola cratericola Shenk 1974 species group", {"genus": "Acarospora", "sp": "cratericola", "isp": "cratericola", "rank": "SUBSPECIES", "comb": "Shenk", "year": "1974"}),
    ("Achillea bonarota nom. in herb.", {"genus": "Achillea", "sp": "bonarota", "rank": "SPECIES", "nom": "nom. in herb."}),
    ("Achillea millefolium L. s.s. - junk here", {"genus": "Achillea", "sp": "millefolium", "rank": "SPECIES", "comb": "L.", "tax": "s.s.", "unparsed": "- junk here"}),
    ("Achillea millefolium agg. L.", {"comb": "L."}),
    ("Achromobacter Yabuuchi and Yano, 1981 emend. Yabuuchi et al., 1998", {"uni": "Achromobacter", "comb": "Yabuuchi|Yano", "year": "1981", "tax": "emend. Yabuuchi et al., 1998", "code": "ZOOLOGICAL"}),
    ("Acipenser gueldenstaedti colchicus natio danubicus Movchan, 1967", {"genus": "Acipenser", "sp": "gueldenstaedti", "isp": "danubicus", "rank": "NATIO", "comb": "Movchan", "year": "1967", "code": "ZOOLOGICAL"}),
    ("Aconitum napellus var. formosum (Rchb.) W. D. J. Koch (nom. ambig.)", {"genus": "Aconitum", "sp": "napellus", "isp": "formosum", "rank": "VARIETY", "comb": "W.D.J.Koch", "bas": "Rchb.", "code": "BOTANICAL", "nom": "nom. ambig."}),
    ("Acontias lineatus WAGLER 1830: 196 (nomen nudum)", {"genus": "Acontias", "sp": "lineatus", "rank": "SPECIES", "comb": "Wagler", "year": "1830"}),
    ("Acranthera virescens (Ridl.) ined.", {"genus": "Acranthera", "sp": "virescens", "rank": "SPECIES", "bas": "Ridl.", "nom": "ined.", "code": "ZOOLOGICAL"}),
    ("Aeonium nothosect. Leugalonium", {"genus": "Aeonium", "sub": "Leugalonium", "code": "BOTANICAL"}),
    ("Agalinis purpurea (L.) Briton var. borealis (Berg.) Peterson 1987", {"genus": "Agalinis", "sp": "purpurea", "isp": "borealis", "rank": "VARIETY", "comb": "Peterson", "year": "1987", "bas": "Berg."}),
    ("Agama annectans Blanford, 1870 [orth. error]", {"genus": "Agama", "sp": "annectans", "rank": "SPECIES", "comb": "Blanford", "year": "1870", "nom": "orth. error", "code": "ZOOLOGICAL"}),
    ("Agaricus collinitus β mucosus (Bull.) Fr.", {"genus": "Agaricus", "sp": "collinitus", "isp": "mucosus", "rank": "INFRASPECIFIC_NAME", "comb": "Fr.", "bas": "Bull.", "code": "BOTANICAL"}),
    ("Agropyron pectiniforme var. karabaljikji ined.?", {"genus": "Agropyron", "sp": "pectiniforme", "isp": "karabaljikji", "rank": "VARIETY", "unparsed": "ined"}),
    ("Agrostis compressa Willd., nom. superfl.", {"genus": "Agrostis", "sp": "compressa", "rank": "SPECIES", "comb": "Willd.", "nom": "nom. superfl.", "code": "BOTANICAL"}),
    ("Agrostis hyemalis (Walter) Britton, Sterns, & Poggenb.", {"genus": "Agrostis", "sp": "hyemalis", "rank": "SPECIES", "comb": "Britton|Sterns|Poggenb.", "bas": "Walter", "code": "BOTANICAL"}),
    ("Alpha proteobacterium RNA12", {"genus": "Alpha", "sp": "proteobacterium", "rank": "SPECIES", "phrase": "RNA12"}),
    ("Amathia tricornis Busk ms in Chimonides, 1987", {"genus": "Amathia", "sp": "tricornis", "rank": "SPECIES", "comb": "Busk", "year": "1987", "nom": "ms"}),
    ("Amelanchier arborea f. hirsuta (Michx. f.) Fernald", {"genus": "Amelanchier", "sp": "arborea", "isp": "hirsuta", "rank": "FORM", "comb": "Fernald", "bas": "Michx.f.", "code": "BOTANICAL"}),
    ("Amphiprora pseudoduplex (Osada & Kobayasi, 1990) comb. nov.", {"genus": "Amphiprora", "sp": "pseudoduplex", "rank": "SPECIES", "bas": "Osada|Kobayasi", "code": "ZOOLOGICAL", "nom": "comb. nov."}),
    ("Androrchis × fallax (De Not.) W.Foelsche & Jakely", {"genus": "Androrchis", "sp": "fallax", "rank": "SPECIES", "comb": "W.Foelsche|Jakely", "bas": "De Not."}),
    ("Antacanthus Rich. ex DC., Prodr. 4: 484 (1830), pro syn.", {"uni": "Antacanthus", "comb": "DC.", "year": "1830", "nom": "pro syn."}),
    ("Anthoscopus Cabanis [1851]", {"uni": "Anthoscopus", "comb": "Cabanis"}),
    ("Anthoscopus Cabanis [185?]", {"uni": "Anthoscopus", "comb": "Cabanis"}),
    ("Anthurium lanceum Engl. nom.illeg.", {"genus": "Anthurium", "sp": "lanceum", "rank": "SPECIES", "comb": "Engl.", "nom": "nom. illeg.", "code": "BOTANICAL"}),
    ("Apatura iris junonina (Lambillion) & Cabeau, 1910", {"genus": "Apatura", "sp": "iris", "isp": "junonina", "rank": "INFRASPECIFIC_NAME", "bas": "Lambillion", "comb": "Cabeau", "year": "1910"}),
    ("Aquimarina muelleri DSM 19832", {"genus": "Aquimarina", "sp": "muelleri", "rank": "SPECIES", "phrase": "DSM 19832"}),
    ("Architectonica offlexa Iredale, 1931", {"genus": "Architectonica", "sp": "offlexa", "rank": "SPECIES", "comb": "Iredale", "year": "1931", "code": "ZOOLOGICAL"}),
    ("Armillaria ostoyae RNA1", {"genus": "Armillaria", "sp": "ostoyae", "rank": "SPECIES", "phrase": "RNA1"}),
    ("Arthopyrenia hyalospora (Nyl.) R.C. Harris comb. nov.", {"genus": "Arthopyrenia", "sp": "hyalospora", "rank": "SPECIES", "comb": "R.C.Harris", "bas": "Nyl.", "nom": "comb. nov."}),
    ("Asplenium anisophyllum Kunze, s.l.", {"genus": "Asplenium", "sp": "anisophyllum", "rank": "SPECIES", "comb": "Kunze", "tax": "s.l."}),
    ("Asplenium trichomanes L. s.lat.", {"genus": "Asplenium", "sp": "trichomanes", "rank": "SPECIES", "comb": "L.", "tax": "s.lat."}),
    ("Asplenium trichomanes L. s.lat. - Asplen trich", {"genus": "Asplenium", "sp": "trichomanes", "rank": "SPECIES", "comb": "L.", "tax": "s.lat.", "unparsed": "- Asplen trich"}),
    ("Aster exilis Ell., nomen dubium", {"genus": "Aster", "sp": "exilis", "rank": "SPECIES", "comb": "Ell.", "nom": "nomen dubium"}),
    ("Aus bus Smith, nomen oblitum", {"genus": "Aus", "sp": "bus", "rank": "SPECIES", "comb": "Smith", "nom": "nomen oblitum", "code": "ZOOLOGICAL"}),
    ("Baccharis microphylla Kunth var. rhomboidea Wedd. ex Sch. Bip. (nom. nud.)", {"genus": "Baccharis", "sp": "microphylla", "isp": "rhomboidea", "rank": "VARIETY", "comb": "Sch.Bip.", "nom": "nom. nud."}),
    ("Bartlingia Brongn. non Rchb. 1824 nec F.Muell. 1882", {"uni": "Bartlingia", "comb": "Brongn.", "tax": "non Rchb. 1824 nec F.Muell. 1882"}),
    ("Basanacantha spinosa var. typica K.Schum., not validly publ.", {"genus": "Basanacantha", "sp": "spinosa", "isp": "typica", "rank": "VARIETY", "comb": "K.Schum.", "nom": "not validly publ."}),
    ("Begonia hatacoa var. viridifolia Golding & Rekha Morris, without type.", {"genus": "Begonia", "sp": "hatacoa", "isp": "viridifolia", "rank": "VARIETY", "comb": "Golding|Rekha Morris", "nom": "without type."}),
    ("Betula pendula fo. dalecarlica (L. f.) C.K. Schneid.", {"genus": "Betula", "sp": "pendula", "isp": "dalecarlica", "rank": "FORM", "comb": "C.K.Schneid.", "bas": "L.f.", "code": "BOTANICAL"}),
    ("Boldiaceae", {"uni": "Boldiaceae", "rank": "FAMILY"}),
    ("Bolivina albatrossi Cushman Em. Sellier de Civrieux, 1976", {"genus": "Bolivina", "sp": "albatrossi", "rank": "SPECIES", "comb": "Cushman Em.Sellier de Civrieux", "year": "1976", "code": "ZOOLOGICAL"}),
    ("Buteo borealis ? ventralis", {"genus": "Buteo", "sp": "borealis", "isp": "ventralis", "rank": "INFRASPECIFIC_NAME"}),
    ("CHIONE ELEV.", {"uni": "Chione", "comb": "Elev."}),
    ("CHIONE ELEVATA VULGARIS", {"genus": "Chione", "sp": "elevata", "isp": "vulgaris", "rank": "INFRASPECIFIC_NAME"}),
    ("Caecognathia regalis (Monod, 1926A)", {"genus": "Caecognathia", "sp": "regalis", "rank": "SPECIES", "bas": "Monod", "code": "ZOOLOGICAL"}),
    ("Calathus (Lindrothius) KURNAKOV 1961", {"genus": "Calathus", "sub": "Lindrothius", "comb": "Kurnakov", "year": "1961", "code": "ZOOLOGICAL"}),
    ("Calicium furfuraceum * furfuraceum (L.) Pers. 1797", {"genus": "Calicium", "sp": "furfuraceum", "isp": "furfuraceum", "rank": "INFRASPECIFIC_NAME", "comb": "Pers.", "year": "1797", "bas": "L."}),
    ("Candida albicans RNA_CTR0-3", {"genus": "Candida", "sp": "albicans", "rank": "SPECIES", "phrase": "RNA_CTR0-3"}),
    ("Canis lupus subsp. Linnaeus, 1758", {"comb": "Linnaeus", "year": "1758", "code": "ZOOLOGICAL"}),
    ("Cantharellus sinuosus var. multiplex(A.H.Sm.) Romagn., 1995", {"genus": "Cantharellus", "sp": "sinuosus", "isp": "multiplex", "rank": "VARIETY", "comb": "Romagn.", "year": "1995", "bas": "A.H.Sm."}),
    ("Centropyge fisheri non (Snyder, 1904)", {"genus": "Centropyge", "sp": "fisheri", "rank": "SPECIES", "tax": "non (Snyder, 1904)"}),
    ("Ceratium hirundinella (Paulsen) Loeblich III, 1969", {"genus": "Ceratium", "sp": "hirundinella", "rank": "SPECIES", "bas": "Paulsen", "comb": "Loeblich III", "year": "1969"}),
    ("Ceratium hirundinella (Paulsen) Loeblich Iii, 1969", {"genus": "Ceratium", "sp": "hirundinella", "rank": "SPECIES", "bas": "Paulsen", "comb": "Loeblich III", "year": "1969"}),
    ("Chlorocyperus glaber form. fasciculariforme (Lojac.) Soó", {"genus": "Chlorocyperus", "sp": "glaber", "isp": "fasciculariforme", "rank": "FORM", "comb": "Soó", "bas": "Lojac.", "code": "BOTANICAL"}),
    ("Cirsium creticum Balsamo M Fregni E Tongiorgi P", {"genus": "Cirsium", "sp": "creticum", "rank": "SPECIES", "comb": "M.Balsamo|E.Fregni|P.Tongiorgi"}),
    ("Cirsium creticum Balsamo M Todaro MA", {"genus": "Cirsium", "sp": "creticum", "rank": "SPECIES", "comb": "M.Balsamo|M.A.Todaro"}),
    ("Cirsium creticum d'Urv.", {"genus": "Cirsium", "sp": "creticum", "rank": "SPECIES", "comb": "d'Urv."}),
    ("Combretum Loefl. (1758), nom. cons. [= Grislea L. 1753].", {"uni": "Combretum", "comb": "Loefl.", "year": "1758", "nom": "nom. cons.", "unparsed": "[= Grislea L. 1753].", "code": "BOTANICAL"}),
    ("Cordia (Adans.) Kuntze sect. Salimori", {"genus": "Cordia", "sub": "Salimori", "code": "BOTANICAL"}),
    ("Coronaviridae", {"uni": "Coronaviridae", "rank": "FAMILY", "code": "VIRUS"}),
    ("Ctenotus alacer Storr, 1887 (\"1886-1888\")", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1887", "code": "ZOOLOGICAL"}),
    ("Ctenotus alacer Storr, 1970 (\"1969\")", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1970", "code": "ZOOLOGICAL"}),
    ("Ctenotus alacer Storr, 1970 (imprint 1969)", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1970", "code": "ZOOLOGICAL"}),
    ("Ctenotus alacer Storr, 1970 (not 1969)", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1970", "code": "ZOOLOGICAL"}),
    ("Ctenotus alacer Storr, 1970 [\"1969\"]", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1970", "code": "ZOOLOGICAL"}),
    ("Ctenotus alacer Storr, 1970 [1969]", {"genus": "Ctenotus", "sp": "alacer", "rank": "SPECIES", "comb": "Storr", "year": "1970", "code": "ZOOLOGICAL"}),
    ("Cyclotus amethystinus var. β Guppy, 1868", {"genus": "Cyclotus", "sp": "amethystinus", "isp": "β", "rank": "VARIETY", "comb": "Guppy", "year": "1868", "code": "ZOOLOGICAL"}),
    ("Cymbella cistula var. sinus regis", {"genus": "Cymbella", "sp": "cistula", "isp": "sinus", "rank": "VARIETY", "unparsed": "regis"}),
    ("Deudorix epijarbas turbo Fruhstorfer, [1912]", {"genus": "Deudorix", "sp": "epijarbas", "isp": "turbo", "rank": "INFRASPECIFIC_NAME", "comb": "Fruhstorfer"}),
    ("Dicranum saxatile Lagasca y Segura, García & Clemente y Rubio, 1802", {"genus": "Dicranum", "sp": "saxatile", "rank": "SPECIES", "comb": "Lagasca|Segura|García|Clemente|Rubio", "year": "1802"}),
    ("Dyadobacter (Chelius & Triplett, 2000) emend. Reddy & Garcia-Pichel, 2005", {"uni": "Dyadobacter", "bas": "Chelius|Triplett", "tax": "emend. Reddy & Garcia-Pichel, 2005", "code": "ZOOLOGICAL"}),
    ("Döringina Ihering 1929 (synonym)", {"uni": "Döringina", "comb": "Ihering|synonym", "year": "1929"}),
    ("Eichornia crassipes ( (Martius) ) Solms-Laub.", {"genus": "Eichornia", "sp": "crassipes", "rank": "SPECIES", "comb": "Solms-Laub.", "bas": "Martius"}),
    ("Endococcus cladiae Zhurb. & Pino-Bodas", {"genus": "Endococcus", "sp": "cladiae", "rank": "SPECIES", "comb": "Zhurb.|Pino-Bodas"}),
    ("Escherichia coli ATCC 11775", {"genus": "Escherichia", "sp": "coli", "rank": "SPECIES", "phrase": "ATCC 11775"}),
    ("Eu-Scalpellum Hoek, 1907", {"uni": "Eu-scalpellum", "comb": "Hoek", "year": "1907"}),
    ("Eunoa [auctt. misspelling for Eunoe]", {"uni": "Eunoa", "tax": "auctt. misspelling for Eunoe"}),
    ("Festuca subg. Schedonorus (P. Beauv. ) Peterm.", {"genus": "Festuca", "sub": "Schedonorus", "comb": "Peterm.", "bas": "P.Beauv.", "code": "BOTANICAL"}),
    ("Fidicina aldegondae (Kuhlgatz in Kuhlgatz and Melichar, 1902), 1902-01-01", {"genus": "Fidicina", "sp": "aldegondae", "rank": "SPECIES", "bas": "Kuhlgatz", "code": "ZOOLOGICAL"}),
    ("Foa (Grev.) Kutz. 1849", {"uni": "Foa", "bas": "Grev.", "comb": "Kutz.", "year": "1849"}),
    ("Foa fo", {"genus": "Foa", "sp": "fo", "rank": "SPECIES"}),
    ("Gahrliepia (G.) tessellata Traub & Morrow 1955", {"genus": "Gahrliepia", "sub": "G.", "sp": "tessellata", "comb": "Traub|Morrow", "year": "1955", "code": "ZOOLOGICAL"}),
    ("Galega officinalis (L.) L'Hèr. subsp. mackayana (O'Flannagan) Mc Inley var. petiolata (È. Neé) Brüch.", {"genus": "Galega", "sp": "officinalis", "isp": "petiolata", "rank": "VARIETY", "comb": "Brüch.", "bas": "È.Neé"}),
    ("Gastrosericus eremorum von Beaumont 1955", {"genus": "Gastrosericus", "sp": "eremorum", "rank": "SPECIES", "comb": "von Beaumont", "year": "1955", "code": "ZOOLOGICAL"}),
    ("Genoplesium vernalis D.L.Jones ms.", {"genus": "Genoplesium", "sp": "vernalis", "rank": "SPECIES", "comb": "D.L.Jones", "nom": "ms."}),
    ("Gnathamitermes tubiformans (Buckley, 1862), 1862-01-01", {"genus": "Gnathamitermes", "sp": "tubiformans", "rank": "SPECIES", "bas": "Buckley", "comb": "", "year": "1862", "code": "ZOOLOGICAL"}),
    ("Gnatholigota Sharp in Sharp & Scott, 1908", {"uni": "Gnatholigota", "comb": "Sharp", "year": "1908"}),
    ("Grielum obtusifolium ex Harv.", {"genus": "Grielum", "sp": "obtusifolium", "rank": "SPECIES", "comb": "Harv."}),
    ("Handmannia austriaca f. elliptica Handmann fide Hustedt, 1922", {"genus": "Handmannia", "sp": "austriaca", "isp": "elliptica", "rank": "FORM", "comb": "Handmann", "tax": "fide Hustedt, 1922"}),
    ("Hebeloma album Peck 1900 non ss. auct. europ.", {"genus": "Hebeloma", "sp": "album", "rank": "SPECIES", "comb": "Peck", "year": "1900", "tax": "non ss. auct. europ.", "code": "ZOOLOGICAL"}),
    ("Hegeter (Hegeter) intercedens Lindberg H 1950", {"genus": "Hegeter", "sub": "Hegeter", "sp": "intercedens", "comb": "H.Lindberg", "year": "1950"}),
    ("Helophorus (Lihelophorus) ser Zaitzev, 1908", {"comb": "Zaitzev", "year": "1908", "code": "ZOOLOGICAL"}),
    ("Heptacyclus (Vasileyev, 1939)", {"uni": "Heptacyclus", "bas": "Vasileyev", "code": "ZOOLOGICAL"}),
    ("Hexaconthium pachydermum form A Cortese & Bjørklund 1998", {"genus": "Hexaconthium", "sp": "pachydermum", "isp": "A", "rank": "FORM", "comb": "Cortese|Bjørklund", "year": "1998", "code": "ZOOLOGICAL"}),
    ("Iris germanica nothovar. florentina", {"genus": "Iris", "sp": "germanica", "isp": "florentina", "rank": "VARIETY"}),
    ("Jezzinothrips cretacicus amazur Strassen, 1973", {"genus": "Jezzinothrips", "sp": "cretacicus", "isp": "amazur", "rank": "SUBSPECIES", "comb": "Strassen", "year": "1973", "code": "ZOOLOGICAL"}),
    ("Kyphocarpa (Fenzl) Lopr.", {"uni": "Kyphocarpa", "bas": "Fenzl", "comb": "Lopr.", "code": "BOTANICAL"}),
    ("Lachenalia tricolor var. nelsonii (anon.) Baker", {"genus": "Lachenalia", "sp": "tricolor", "isp": "nelsonii", "rank": "VARIETY", "comb": "Baker", "unparsed": "(anon.)"}),
    ("Lachenalia tricolor var. nelsonii (auct.) Baker", {"genus": "Lachenalia", "sp": "tricolor", "isp": "nelsonii", "rank": "VARIETY", "comb": "Baker", "unparsed": "(auct.)"}),
    ("Lachenalia tricolor var. nelsonii (hort.) Baker", {"genus": "Lachenalia", "sp": "tricolor", "isp": "nelsonii", "rank": "VARIETY", "comb": "Baker", "unparsed": "(hort.)"}),
    ("Lachenalia tricolor var. nelsonii (ht.) Baker", {"genus": "Lachenalia", "sp": "tricolor", "isp": "nelsonii", "rank": "VARIETY", "comb": "Baker", "unparsed": "(hort.)"}),
    ("Lamprostiba pu!chra Pace, 2014", {"genus": "Lamprostiba", "sp": "pu!chra", "rank": "SPECIES", "comb": "Pace", "year": "2014", "code": "ZOOLOGICAL"}),
    ("Latrodectus marikitates sensu Whittaker", {"genus": "Latrodectus", "sp": "marikitates", "rank": "SPECIES", "tax": "sensu Whittaker"}),
    ("Lepidodens similis Zhang F & Pan Z-X in Zhang, F, Pan, Z-X, Wu, J, Ding, Y-H, Yu, D-Y & Wang, B-X, 2016", {"genus": "Lepidodens", "sp": "similis", "rank": "SPECIES", "comb": "F.Zhang|Z-X.Pan", "year": "2016"}),
    ("Leucopogon veillonii (Virot) comb. ined.", {"genus": "Leucopogon", "sp": "veillonii", "rank": "SPECIES", "bas": "Virot", "nom": "comb. ined.", "code": "ZOOLOGICAL"}),
    ("Lindera Thunb. non Adans. 1763", {"uni": "Lindera", "comb": "Thunb.", "tax": "non Adans. 1763"}),
    ("Lynceus huentelauquensis  Sigvardt, Rogers, De los Ríos, Palero, and Olesen, 2019", {"genus": "Lynceus", "sp": "huentelauquensis", "rank": "SPECIES", "comb": "Sigvardt|Rogers|De los Ríos|Palero|Olesen", "year": "2019", "code": "ZOOLOGICAL"}),
    ("Membranipora minuscula Canu, 1911 non Hincks, 1882", {"genus": "Membranipora", "sp": "minuscula", "rank": "SPECIES", "comb": "Canu", "year": "1911", "tax": "non Hincks, 1882"}),
    ("Menestoria tocoyenae DC., provisionally listed as a synonym.", {"genus": "Menestoria", "sp": "tocoyenae", "rank": "SPECIES", "comb": "DC."}),
    ("Mesotrichia senior (Vachal)", {"genus": "Mesotrichia", "sp": "senior", "rank": "SPECIES", "bas": "Vachal", "code": "ZOOLOGICAL"}),
    ("Methanosarcina barkeri str. fusaro", {"genus": "Methanosarcina", "sp": "barkeri", "isp": "fusaro", "rank": "STRAIN"}),
    ("Mica Budde-Lund in Voeltzkow, 1908", {"uni": "Mica", "comb": "Budde-Lund", "year": "1908"}),
    ("Micromeria cristata subsp. kosaninii ( ilic) ined.", {"genus": "Micromeria", "sp": "cristata", "isp": "kosaninii", "rank": "SUBSPECIES", "unparsed": "(ilic)", "nom": "ined."}),
    ("Mo. alpium (Osbeck, 1778)", {"genus": "Mo.", "sp": "alpium", "rank": "SPECIES", "bas": "Osbeck", "code": "ZOOLOGICAL"}),
    ("Moraea spathulata ( (L. f. Klatt", {"genus": "Moraea", "sp": "spathulata", "rank": "SPECIES", "comb": "L.f.Klatt"}),
    ("Morea (Morea) Burt 2342343242 23424322342 23424234", {"comb": "Burt"}),
    ("Morea (Morea) burtius 2342343242 23424322342 23424234", {"genus": "Morea", "sub": "Morea", "sp": "burtius"}),
    ("Musca capraria Trustees of the British Museum (Natural History), 1939", {"genus": "Musca", "sp": "capraria", "rank": "SPECIES", "comb": "Trustees of the British Museum Natural History", "year": "1939"}),
    ("Mycosphaerella eryngii (Fr. Duby) ex Oudem. 1897", {"genus": "Mycosphaerella", "sp": "eryngii", "rank": "SPECIES", "comb": "Oudem.", "year": "1897", "bas": "Fr.Duby"}),
    ("Mycosphaerella eryngii (Fr. ex. Duby) Johanson ex. Oudem. 1897", {"genus": "Mycosphaerella", "sp": "eryngii", "rank": "SPECIES", "comb": "Oudem.", "year": "1897", "bas": "Duby"}),
    ("Natica of nidus", {"uni": "Natica", "comb": "of nidus"}),
    ("Navicula ambigua f. craticularis Istv?nffi, 1898, 1897", {"genus": "Navicula", "sp": "ambigua", "isp": "craticularis", "rank": "FORM", "comb": "Istvnffi", "year": "1898", "code": "ZOOLOGICAL"}),
    ("Naviculadicta witkowskii LB & Metzeltin nov spec", {"genus": "Naviculadicta", "sp": "witkowskii", "rank": "SPECIES", "comb": "LB|Metzeltin", "nom": "nov spec."}),
    ("Nitocris (Nitocris) similis Breuning, 1956 (nec Gahan, 1893)", {"comb": "Breuning", "year": "1956", "tax": "nec Gahan, 1893", "code": "ZOOLOGICAL"}),
    ("Nitzschia sinuata var. (Grunow) Lange-Bert.", {"bas": "Grunow", "comb": "Lange-Bert.", "code": "BOTANICAL"}),
    ("Notopholia corrusca", {"genus": "Notopholia", "sp": "corrusca", "rank": "SPECIES"}),
    ("Nototriton matama Boza-Oviedo, Rovito, Chaves, García-Rodríguez, Artavia, Bolaños, and Wake, 2012", {"genus": "Nototriton", "sp": "matama", "rank": "SPECIES", "comb": "Boza-Oviedo|Rovito|Chaves|García-Rodríguez|Artavia|Bolaños|Wake", "year": "2012", "code": "ZOOLOGICAL"}),
    ("Oligota (Logiota) Mulsant & Rey 1873", {"genus": "Oligota", "sub": "Logiota", "comb": "Mulsant|Rey", "year": "1873", "code": "ZOOLOGICAL"}),
    ("Ospriocerus arizonensis (Bromley, 193k7)", {"genus": "Ospriocerus", "sp": "arizonensis", "rank": "SPECIES", "bas": "Bromley", "code": "ZOOLOGICAL"}),
    ("Oxalis barrelieri XXZ_21243", {"genus": "Oxalis", "sp": "barrelieri", "rank": "SPECIES", "unparsed": "XXZ_21243"}),
    ("Passalus (Pertinax) gaboi Jiménez-Maxim & Reyes, 2022", {"genus": "Passalus", "sub": "Pertinax", "sp": "gaboi", "comb": "Jiménez-Maxim|Reyes", "year": "2022", "code": "ZOOLOGICAL"}),
    ("Passiflora possible Müller", {"genus": "Passiflora", "sp": "possible", "rank": "SPECIES", "comb": "Müller"}),
    ("Pelargonium cucullatum ssp. cucullatum (L.) L'Her. ex [Soland.]", {"genus": "Pelargonium", "sp": "cucullatum", "isp": "cucullatum", "rank": "SUBSPECIES", "comb": "Soland.", "bas": "L.", "code": "BOTANICAL"}),
    ("Peristernia nassatula forskali Tapparone-Canefri 1875", {"genus": "Peristernia", "sp": "nassatula", "isp": "forskali", "rank": "SUBSPECIES", "comb": "Tapparone-Canefri", "year": "1875", "code": "ZOOLOGICAL"}),
    ("Phalaena (Tin.) guttella Fab.", {"genus": "Phalaena", "sub": "Tin.", "sp": "guttella", "comb": "Fab."}),
    ("Pitcairnia cinnagarina ex D. Dietr.", {"genus": "Pitcairnia", "sp": "cinnagarina", "rank": "SPECIES", "comb": "D.Dietr."}),
    ("Platypus bicaudatulus Schedl 1935", {"genus": "Platypus", "sp": "bicaudatulus", "rank": "SPECIES", "comb": "Schedl", "year": "1935", "code": "ZOOLOGICAL"}),
    ("Pleurotus ëous (Berk.) Sacc. 1887", {"genus": "Pleurotus", "sp": "ëous", "rank": "SPECIES", "comb": "Sacc.", "year": "1887", "bas": "Berk."}),
    ("Poa pratensis kewensis primula (L.) Rouy, 1913", {"genus": "Poa", "sp": "pratensis", "isp": "primula", "rank": "INFRASUBSPECIFIC_NAME", "comb": "Rouy", "year": "1913", "bas": "L."}),
    ("Polygala vulgaris L., 1753 [nom. et typ. cons.]", {"genus": "Polygala", "sp": "vulgaris", "rank": "SPECIES", "comb": "L.", "year": "1753", "nom": "nom. & typ. cons.", "code": "BOTANICAL"}),
    ("Polygala vulgaris L., 1753, nom. cons.", {"genus": "Polygala", "sp": "vulgaris", "rank": "SPECIES", "comb": "L.", "year": "1753", "nom": "nom. cons.", "code": "BOTANICAL"}),
    ("Polygonum subgen. Bistorta (L.) Zernov", {"genus": "Polygonum", "sub": "Bistorta", "comb": "Zernov", "bas": "L.", "code": "BOTANICAL"}),
    ("Polypodium pectinatum L. f.", {"genus": "Polypodium", "sp": "pectinatum", "rank": "SPECIES", "comb": "L.f."}),
    ("Polypodium pectinatum L.f. typica Rosenst.", {"genus": "Polypodium", "sp": "pectinatum", "isp": "typica", "rank": "FORM", "comb": "Rosenst."}),
    ("Prion Lacépède, 1799", {"uni": "Prion", "comb": "Lacépède", "year": "1799", "code": "ZOOLOGICAL"}),
    ("Proboscina subechinata Canu & Bassler, 1920 non d'Orbigny, 1853", {"genus": "Proboscina", "sp": "subechinata", "rank": "SPECIES", "comb": "Canu|Bassler", "year": "1920", "tax": "non d'Orbigny, 1853"}),
    ("Protocystis xiphodon  (Haeckel, 1887), Borgert, 1901", {"genus": "Protocystis", "sp": "xiphodon", "rank": "SPECIES", "bas": "Haeckel", "comb": "Borgert", "year": "1901"}),
    ("Protoventuria rosae (De Not.) Berl. & Sacc.", {"genus": "Protoventuria", "sp": "rosae", "rank": "SPECIES", "comb": "Berl.|Sacc.", "bas": "De Not.", "code": "BOTANICAL"}),
    ("Prunus mexicana S. Watson var. reticulata (Sarg.) Sarg.", {"genus": "Prunus", "sp": "mexicana", "isp": "reticulata", "rank": "VARIETY", "comb": "Sarg.", "bas": "Sarg.", "code": "BOTANICAL"}),
    ("Pseudocercospora Speg. 1910", {"uni": "Pseudocercospora", "comb": "Speg.", "year": "1910"}),
    ("Pseudocercospora broussonetiae (Chupp & Linder) X.J. Liu & Y.L. Guo 1989", {"genus": "Pseudocercospora", "sp": "broussonetiae", "rank": "SPECIES", "comb": "X.J.Liu|Y.L.Guo", "year": "1989", "bas": "Chupp|Linder"}),
    ("Pseudomonas syringae pv. aceris (Ark, 1939) Young, Dye & Wilkie, 1978", {"genus": "Pseudomonas", "sp": "syringae", "isp": "aceris", "rank": "PATHOVAR", "comb": "Young|Dye|Wilkie", "year": "1978", "bas": "Ark", "code": "BACTERIAL"}),
    ("Puntius arulius subsp. tambraparniei (non Silas 1954)", {"genus": "Puntius", "sp": "arulius", "isp": "tambraparniei", "rank": "SUBSPECIES", "tax": "non Silas 1954"}),
    ("Puya acris Auct non L.", {"genus": "Puya", "sp": "acris", "rank": "SPECIES", "tax": "auct non L."}),
    ("Puya acris Auct.", {"genus": "Puya", "sp": "acris", "rank": "SPECIES", "tax": "auct."}),
    ("Pycnophyes Auctt., non Zelinka, 1907", {"uni": "Pycnophyes", "tax": "auctt., non Zelinka, 1907"}),
    ("Ramaria subbotrytis (Coker) Corner 1950 ss. auct. europ.", {"genus": "Ramaria", "sp": "subbotrytis", "rank": "SPECIES", "bas": "Coker", "comb": "Corner", "year": "1950", "tax": "ss. auct. europ."}),
    ("Regulus modestus mihi. Gould 1837", {"genus": "Regulus", "sp": "modestus", "rank": "SPECIES", "comb": "Gould", "year": "1837", "code": "ZOOLOGICAL"}),
    ("Roridomyces albororidus (Maas Geest. & de Meijer) anon., 2010", {"genus": "Roridomyces", "sp": "albororidus", "rank": "SPECIES", "bas": "Maas Geest.|de Meijer", "comb": "anon.", "year": "2010"}),
    ("Rubus fruticosus agamovar. graecensis (W.Maurer) A. & D. Löve", {"genus": "Rubus", "sp": "fruticosus", "isp": "graecensis", "rank": "VARIETY", "comb": "A.|D.Löve", "bas": "W.Maurer", "code": "BOTANICAL"}),
    ("Saccharomyces drosophilae Anon", {"genus": "Saccharomyces", "sp": "drosophilae", "rank": "SPECIES", "comb": "anon."}),
    ("Salmonella werahensis (Castellani) Hauduroy and Ehringer in Hauduroy 1937", {"genus": "Salmonella", "sp": "werahensis", "rank": "SPECIES", "comb": "Hauduroy|Ehringer", "year": "1937", "bas": "Castellani"}),
    ("Saxo-Fridericia R. H. Schomb.", {"uni": "Saxo-Fridericia", "comb": "R.H.Schomb."}),
    ("Scopula cajanderi (Herz, 1903), 1903-01-01", {"genus": "Scopula", "sp": "cajanderi", "rank": "SPECIES", "bas": "Herz", "comb": "", "year": "1903", "code": "ZOOLOGICAL"}),
    ("Selenops ab Logunov & Jäger, 2015", {"genus": "Selenops", "sp": "ab", "rank": "SPECIES", "comb": "Logunov|Jäger", "year": "2015", "code": "ZOOLOGICAL"}),
    ("Senecio legionensis sensu Samp., non Lange", {"genus": "Senecio", "sp": "legionensis", "rank": "SPECIES", "tax": "sensu Samp., non Lange"}),
    ("Serapias nothosubsect. Pladiopetalae", {"genus": "Serapias", "sub": "Pladiopetalae", "code": "BOTANICAL"}),
    ("Sicyoniidae † Ortmann, 1898", {"uni": "Sicyoniidae", "comb": "Ortmann", "year": "1898", "code": "ZOOLOGICAL"}),
    ("Simia (Cercop.) nasuus Kerr 1792", {"comb": "Kerr", "year": "1792", "code": "ZOOLOGICAL"}),
    ("Strombus vittatus entropi Man in't Veld & Visser, 1993", {"genus": "Strombus", "sp": "vittatus", "isp": "entropi", "rank": "SUBSPECIES", "comb": "Man in't Veld|Visser", "year": "1993", "code": "ZOOLOGICAL"}),
    ("Taraxacum piet-oosterveldii H. Øllg. in press", {"genus": "Taraxacum", "sp": "piet-oosterveldii", "rank": "SPECIES", "comb": "H.Øllg.", "nom": "in press"}),
    ("Tenthredo (Macrophya) Dahlbom, 1835", {"genus": "Tenthredo", "sub": "Macrophya", "comb": "Dahlbom", "year": "1835", "code": "ZOOLOGICAL"}),
    ("Thelephora cuticularis Berk. ss. auct. europ.", {"genus": "Thelephora", "sp": "cuticularis", "rank": "SPECIES", "comb": "Berk.", "tax": "ss. auct. europ."}),
    ("Thliphthisa (Griseb.) P.Caputo & Del Guacchio", {"uni": "Thliphthisa", "bas": "Griseb.", "comb": "P.Caputo|Del Guacchio", "code": "BOTANICAL"}),
    ("Tragacantha leporina (?) Kuntze", {"genus": "Tragacantha", "sp": "leporina", "rank": "SPECIES", "comb": "Kuntze", "unparsed": "(?)"}),
    ("Trianosperma ficifolia var. βrigida Cogn.", {"genus": "Trianosperma", "sp": "ficifolia", "isp": "βrigida", "rank": "VARIETY", "comb": "Cogn."}),
    ("Triticum repens var. vulgäre", {"genus": "Triticum", "sp": "repens", "isp": "vulgäre", "rank": "VARIETY"}),
    ("Tuber liui A S. Xu 1999", {"genus": "Tuber", "sp": "liui", "rank": "SPECIES", "comb": "A.S.Xu", "year": "1999", "code": "ZOOLOGICAL"}),
    ("Velutina haliotoides (Linnaeus, 1758) <i>sensu</i> Fabricius, 1780", {"genus": "Velutina", "sp": "haliotoides", "rank": "SPECIES", "bas": "Linnaeus", "tax": "sensu Fabricius, 1780", "code": "ZOOLOGICAL"}),
    ("Vernoniastrum musofense var. miamensis (S. Moore) comb. ined.", {"genus": "Vernoniastrum", "sp": "musofense", "isp": "miamensis", "rank": "VARIETY", "bas": "S.Moore", "nom": "comb. ined.", "code": "ZOOLOGICAL"}),
    ("Verpericola megasoma \"\"Dall\" Pils.", {"genus": "Verpericola", "sp": "megasoma", "rank": "SPECIES", "comb": "Dall Pils."}),
    ("Vittaria auct.", {"uni": "Vittaria", "tax": "auct."}),
    ("Vulpes vulpes sp. silaceus Miller, 1907", {"genus": "Vulpes", "sp": "vulpes", "isp": "silaceus", "rank": "SUBSPECIES", "comb": "Miller", "year": "1907", "code": "ZOOLOGICAL"}),
    ("Woodsiaceae (Hooker) Herter", {"uni": "Woodsiaceae", "rank": "FAMILY", "comb": "Herter", "bas": "Hooker", "code": "BOTANICAL"}),
    ("XAgroelymus Lapage sect. Agroelinelymus", {"code": "BOTANICAL"}),
    ("XAgropogon P.Fourn.", {"uni": "Agropogon", "comb": "P.Fourn."}),
    ("Xanthomonas axonopodis pathovar. phaseoli", {"genus": "Xanthomonas", "sp": "axonopodis", "isp": "phaseoli", "rank": "PATHOVAR"}),
    ("Xylaria potentillae A S. Xu", {"genus": "Xylaria", "sp": "potentillae", "rank": "SPECIES", "comb": "A.S.Xu"}),
    ("†Amnicola (Amnicola) dubrueilliana [sic]", {"genus": "Amnicola", "sub": "Amnicola", "sp": "dubrueilliana"}),
)
