"""Names of repeat classes in graphs."""

#: Class name -> graph group; a class without an entry is a group of its own.
GRAPH_GROUPS = {
    "DNA/Chompy": "DNA",
    "DNA/CMC-Chapaev": "DNA/CMC",
    "DNA/CMC-Chapaev-3": "DNA/CMC",
    "DNA/CMC-EnSpm": "DNA/CMC",
    "DNA/CMC-Transib": "DNA/CMC",
    "DNA/En-Spm": "DNA/CMC",
    "DNA/Crypton-3": "DNA/Crypton",
    "DNA/PIF-Harbinger": "DNA/Harbinger",
    "DNA/PIF-ISL2EU": "DNA/Harbinger",
    "DNA/Tourist": "DNA/Harbinger",
    "DNA/AcHobo": "DNA/hAT",
    "DNA/Charlie": "DNA/hAT",
    "DNA/Chompy1": "DNA/hAT",
    "DNA/MER1_type": "DNA/hAT",
    "DNA/Tip100": "DNA/hAT",
    "DNA/hAT-Ac": "DNA/hAT",
    "DNA/hAT-Blackjack": "DNA/hAT",
    "DNA/hAT-Charlie": "DNA/hAT",
    "DNA/hAT-Tag1": "DNA/hAT",
    "DNA/hAT-Tip100": "DNA/hAT",
    "DNA/hAT-hATw": "DNA/hAT",
    "DNA/hAT-hobo": "DNA/hAT",
    "DNA/hAT_Tol2": "DNA/hAT",
    "DNA/Kolobok-IS4EU": "DNA/Kolobok",
    "DNA/Kolobok-T2": "DNA/Kolobok",
    "DNA/T2": "DNA/Kolobok",
    "DNA/MULE-MuDR": "DNA/MULE",
    "DNA/MULE-NOF": "DNA/MULE",
    "DNA/MuDR": "DNA/MULE",
    "DNA/piggyBac": "DNA/PiggyBac",
    "DNA/MER2_type": "DNA/TcMar",
    "DNA/Mariner": "DNA/TcMar",
    "DNA/Pogo": "DNA/TcMar",
    "DNA/Stowaway": "DNA/TcMar",
    "DNA/Tc1": "DNA/TcMar",
    "DNA/Tc2": "DNA/TcMar",
    "DNA/Tc4": "DNA/TcMar",
    "DNA/TcMar-Fot1": "DNA/TcMar",
    "DNA/TcMar-ISRm11": "DNA/TcMar",
    "DNA/TcMar-Mariner": "DNA/TcMar",
    "DNA/TcMar-Pogo": "DNA/TcMar",
    "DNA/TcMar-Tc1": "DNA/TcMar",
    "DNA/TcMar-Tc2": "DNA/TcMar",
    "DNA/TcMar-Tigger": "DNA/TcMar",
    "DNA/Tigger": "DNA/TcMar",
    "DNA/Helitron": "RC/Helitron",
    "LTR/DIRS1": "LTR/DIRS",
    "LTR/ERV-Foamy": "LTR/ERVL",
    "LTR/ERV-Lenti": "LTR/ERV",
    "LTR/ERVL-MaLR": "LTR/ERVL",
    "LTR/Gypsy-Troyka": "LTR/Gypsy",
    "LTR/MaLR": "LTR/ERVL",
    "LINE/CR1-Zenon": "LINE/CR1",
    "LINE/I": "LINE/Jockey-I",
    "LINE/Jockey": "LINE/Jockey-I",
    "LINE/L1-Tx1": "LINE/L1",
    "LINE/R2-Hero": "LINE/R2",
    "LINE/RTE-BovB": "LINE/RTE",
    "LINE/RTE-RTE": "LINE/RTE",
    "LINE/RTE-X": "LINE/RTE",
    "LINE/telomeric": "LINE/Jockey-I",
    "LINE/Penlope": "PLE",
    "PLE/Hydra": "PLE",
    "PLE/Naiad": "PLE",
    "PLE/Athena": "PLE",
    "PLE/Poseidon": "PLE",
    "PLE/Nematis": "PLE",
    "PLE/Neptune": "PLE",
    "PLE/Coprina": "PLE",
    "SINE/B2": "SINE/tRNA",
    "SINE/B4": "SINE/tRNA-Alu",
    "SINE/BovA": "SINE/tRNA-RTE",
    "SINE/C": "SINE/tRNA",
    "SINE/Core": "SINE",
    "SINE/ID": "SINE/tRNA",
    "SINE/Lys": "SINE/tRNA",
    "SINE/MERMAID": "SINE/tRNA-V",
    "SINE/RTE-BovB": "SINE/RTE",
    "SINE/tRNA-Glu": "SINE/tRNA",
    "SINE/tRNA-Lys": "SINE/tRNA",
    "SINE/V": "SINE/tRNA-V",
    "Unknown/Y-chromosome": "Unknown",
    "DNA/CMC-3": "DNA/CMC",
    "DNA/CMC-Mirage": "DNA/CMC",
    "DNA/Dada": "DNA/Dada",
    "DNA/Kolobok-Hydra": "DNA/Kolobok",
    "DNA/MULE-F": "DNA/MULE",
    "DNA/TcMar-Stowaway": "DNA/TcMar",
    "DNA/TcMar-Tc4": "DNA/TcMar",
    "DNA/TcMar-m44": "DNA/TcMar",
    "DNA/hAT-Pegasus": "DNA/hAT",
    "DNA/hAT-Tol2": "DNA/hAT",
    "DNA/hAT-hAT1": "DNA/hAT",
    "DNA/hAT-hAT5": "DNA/hAT",
    "DNA/hAT-hAT6": "DNA/hAT",
    "DNA/hAT-hAT19": "DNA/hAT",
    "LINE/CRE": "LINE/CRE",
    "LINE/Jockey-I-I": "LINE/Jockey-I",
    "LINE/I-Jockey": "LINE/Jockey-I",
    "LINE/R2-NeSL": "LINE/R2",
    "LTR/Copia(Xen1)": "LTR/Copia",
    "LTR/ERV4": "LTR/ERV",
    "LTR/Ginger": "LTR/Gypsy",
    "Retroposon": "Other",
    "Other/Composite": "Other",
    "SINE/5S-Deu-L2": "SINE/5S",
    "SINE/5S-Sauria-RTE": "SINE/5S",
    "SINE/L2": "SINE",
    "SINE/Mermaid": "SINE/tRNA",
    "SINE/R2": "SINE",
    "SINE/U": "SINE/U",
    "SINE/Core-RTE": "SINE/RTE",
    "SINE/tRNA-C": "SINE/tRNA",
    "SINE/tRNA-Core-RTE": "SINE/tRNA",
    "SINE/tRNA-Core": "SINE/tRNA",
    "SINE/tRNA-Deu-CR1": "SINE/Deu",
    "SINE/tRNA-Deu-L2": "SINE/Deu",
    "SINE/tRNA-Deu": "SINE/Deu",
    "SINE/tRNA-Jockey": "SINE/tRNA",
    "SINE/tRNA-L2": "SINE/tRNA",
    "SINE/tRNA-Rex": "SINE/tRNA",
    "SINE/tRNA-Sauria-L2": "SINE/tRNA",
    "SINE/tRNA-Sauria-RTE": "SINE/tRNA",
    "SINE/tRNA-Sauria": "SINE/tRNA",
    "SINE/Sauria": "SINE/tRNA",
    "SINE/tRNA-V-Core-L2": "SINE/tRNA",
    "SINE/tRNAore-RTE": "SINE/tRNA",
    "SINE/tRNAore": "SINE/tRNA",
    "tRNA": "Structural_RNA",
    "scRNA": "Structural_RNA",
    "RNA": "Structural_RNA",
    "snRNA": "Structural_RNA",
    "rRNA": "Structural_RNA",
    "Satellite/centromeric": "Satellite",
    "Satellite/telomeric": "Satellite",
    "Satellite/acromeric": "Satellite",
}
