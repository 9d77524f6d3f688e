"""Canonical names. Matching is case-insensitive throughout."""

from __future__ import annotations

# Spellings that mean one base collection.
COLLECTIONS = {
    "jet": "JET AK4jet AK4jets Delphes_Jet",
    "muon": "MUON Muo Delphes_Muon",
    "electron": "ELECTRON Ele Elec Delphes_Electron",
    "photon": "PHOTON Pho Delphes_Photon",
    "track": "TRACK Trk",
}
MET = {"met", "missinget", "metlv", "delphes_missinget"}
SCALARS = {"ht", "st", "fht", "scalarht", "delphes_scalarht"}
# Spellings that mean one property.
PROPERTIES = {"mass": "m", "charge": "q", "energy": "e"}
TAGS = {"btag", "ctag", "tautag"}
PARTICLE_FUNCTIONS = {"pt", "eta", "phi", "m", "e"}
# Properties that may also be written as functions of a particle.
PROPERTY_FUNCTIONS = set(
    "m mass q charge flavor constituents daughters pdgif idx p e tautag btag ctag btagdeepb btagdeepflavb btagcsvv2 jetid puid tightid looseid pfisoid msoftdrop tau1 tau2 tau3 dxy edxy edz dz vertr verz very verx vert size eta pt phi theta psi abseta".split()
)
ANGLES = {"dr": "dR", "dphi": "dPhi", "deta": "dEta"}
UNARY = {"sqrt", "cos", "sin", "tan", "log"}
# Names that may be called though nothing computes them unless one is registered.
EXTERNALS = set(
    "none uweight lepsf btagsf xslumicorrsf getindex metsig hlt_iso_mu hlt_trg hstep delta sinh cosh tanh exp fmr fmtr fmegajets antikt fht fmt2 fmtautau comb pdgid meff meff3j meff4j meff5j meff6j applyhm btagmedium eletrigger1 eletrigger2 dphimin dphimin2 mct mtbc htbc ht01 htpho bdt fmeoversqrtsumet fmetoversqrtsumet".split()
)

_BY_SPELLING = {s.lower(): name for name, all_ in COLLECTIONS.items() for s in all_.split()}


def collection(name: str) -> str:
    low = name.lower()
    return _BY_SPELLING.get(low, low)


def prop(name: str) -> str:
    low = name.lower()
    return PROPERTIES.get(low, low)


def is_base(name: str) -> bool:
    return name.lower() in _BY_SPELLING
