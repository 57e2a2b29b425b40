"""Word tables of the normaliser. They are a parameter; DEFAULT holds general knowledge of addresses and company forms in
the three countries with a profile of their own."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


def _pairs(text: str) -> dict[str, str]:
    """word=short, separated by commas; an empty short form drops the word."""
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in text.split(",") if x.strip())}


_US_STATES = _pairs("""alabama=al, alaska=ak, arizona=az, arkansas=ar, california=ca, colorado=co, connecticut=ct, delaware=de, district of columbia=dc, florida=fl, georgia=ga,
hawaii=hi, idaho=id, illinois=il, indiana=in, iowa=ia, kansas=ks, kentucky=ky, louisiana=la, maine=me, maryland=md, massachusetts=ma, michigan=mi, minnesota=mn, mississippi=ms,
missouri=mo, montana=mt, nebraska=ne, nevada=nv, new hampshire=nh, new jersey=nj, new mexico=nm, new york=ny, north carolina=nc, north dakota=nd, ohio=oh, oklahoma=ok, oregon=or,
pennsylvania=pa, rhode island=ri, south carolina=sc, south dakota=sd, tennessee=tn, texas=tx, utah=ut, vermont=vt, virginia=va, washington=wa, west virginia=wv, wisconsin=wi, wyoming=wy""")
_IN_STATES = _pairs("""andhra pradesh=ap, arunachal pradesh=ar, assam=as, bihar=br, chhattisgarh=cg, delhi=dl, goa=ga, gujarat=gj, haryana=hr, himachal pradesh=hp, jharkhand=jh, karnataka=ka,
kerala=kl, madhya pradesh=mp, maharashtra=mh, manipur=mn, odisha=od, orissa=od, punjab=pb, rajasthan=rj, tamil nadu=tn, telangana=tg, uttar pradesh=up, uttarakhand=uk, west bengal=wb""")
_FR_REGIONS = _pairs("""auvergne rhone alpes=ara, bourgogne franche comte=bfc, bretagne=bre, centre val de loire=cvl, corse=cor, grand est=ges, hauts de france=hdf, ile de france=idf, normandie=nor,
nouvelle aquitaine=naq, occitanie=occ, pays de la loire=pdl, provence alpes cote d azur=pac""")
_US_STREET = _pairs("""st=street, str=street, ave=avenue, av=avenue, rd=road, blvd=boulevard, dr=drive, ln=lane, ct=court, pl=place, sq=square, ter=terrace, cir=circle, hwy=highway, pkwy=parkway, expy=expressway,
fwy=freeway, trl=trail, xing=crossing, plz=plaza, ctr=center, mt=mount, ft=fort, n=north, s=south, e=east, w=west, ne=northeast, nw=northwest, se=southeast, sw=southwest, ste=, suite=, apt=, unit=, fl=, floor=, rm=, room=, bldg=building""")
_IN_STREET = _pairs("rd=road, st=street, ngr=nagar, opp=opposite, nr=near, flr=floor, bldg=building, soc=society, apts=apartments, indl=industrial, ind=industrial, est=estate, sec=sector, ph=phase, dist=district, tal=taluka, mkt=market, chk=chowk, hno=, no=, plot=, shop=")
_FR_STREET = _pairs("av=avenue, ave=avenue, bd=boulevard, bld=boulevard, blvd=boulevard, r=rue, pl=place, rte=route, ch=chemin, che=chemin, all=allee, imp=impasse, sq=square, fg=faubourg, fbg=faubourg, st=saint, ste=sainte, bat=batiment, res=residence, zi=zone industrielle")


@dataclass(frozen=True)
class Tables:
    """All words are folded: lower case, without accents."""

    legal: tuple[str, ...] = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "ag", "kg", "sa", "sarl", "sas", "sasu", "eurl", "snc", "srl", "spa", "bv", "nv", "pvt", "private", "pte", "pty", "llp", "lp", "lllp", "pllc", "pc", "oy", "ab", "aps")
    canonical: Mapping[str, str] = field(default_factory=lambda: _pairs("""incorporated=inc, intl=international, internationale=international, mfg=manufacturing, mfrs=manufacturers, bros=brothers, assoc=associates, assocs=associates, assn=association, svc=service, svcs=services, serv=services,
tech=technology, techs=technologies, technol=technology, natl=national, govt=government, univ=university, inst=institute, hosp=hospital, pharm=pharmacy, pharma=pharmaceuticals, ent=enterprises, enterp=enterprises, ents=enterprises, ind=industries, inds=industries, indus=industries,
eng=engineering, engg=engineering, engrs=engineers, elec=electric, elect=electrical, constr=construction, const=construction, dev=development, devt=development, mgmt=management, mgt=management, mktg=marketing, dist=distributors, distr=distributors, comm=communications, fin=finance, ins=insurance,
grp=group, hldgs=holdings, hldg=holding, invt=investment, prod=products, prods=products, rest=restaurant, sys=systems, trdg=trading, trans=transport, transp=transport, ctr=center, centre=center, dept=department, n=and"""))
    street: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {"US": _US_STREET, "IN": _IN_STREET, "FR": _FR_STREET, "GEN": _pairs("st=street, rd=road, ave=avenue, blvd=boulevard, dr=drive, ln=lane, sq=square, bldg=building")})
    states: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {"US": _US_STATES, "IN": _IN_STATES, "FR": _FR_REGIONS, "GEN": _US_STATES})
    cities: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {"IN": _pairs("bombay=mumbai, calcutta=kolkata, madras=chennai, bangalore=bengaluru, poona=pune, baroda=vadodara, gurgaon=gurugram, trivandrum=thiruvananthapuram, cochin=kochi, mysore=mysuru")})
    tlds: tuple[str, ...] = ("co.in", "com", "net", "org", "biz", "info", "co", "in", "us", "uk", "fr", "de", "io", "online", "shop", "store", "site", "app")
    null_words: tuple[str, ...] = ("", "null", "none", "nan", "n/a", "na", "nil", "-", "--", "0", "unknown", "not available")
    stop: tuple[str, ...] = ("street", "road", "avenue", "boulevard", "drive", "lane", "court", "place", "square", "highway", "building", "floor", "north", "south", "east", "west", "near", "opposite", "behind", "the", "and", "rue", "nagar", "district", "sector", "phase", "plot", "suite", "room")
    landmarks: tuple[str, ...] = ("near", "opposite", "opp", "behind", "beside", "above", "below", "next", "adjacent")


DEFAULT = Tables()
