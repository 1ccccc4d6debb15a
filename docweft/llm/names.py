"""Lexicons and small tools for names of people, shared by the operators on names."""

from __future__ import annotations

# Given names and their common short forms (English usage).
NICKNAMES = {
    "alexander": "alex sandy xander lex sasha sascha", "alexandra": "alex sandra lexi sasha", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny benji",
    "catherine": "cathy cath cat", "charles": "charlie chuck chas", "christina": "stina kirsten chris tina chrissy", "christine": "chris chrissy tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy",
    "deborah": "deb debbie", "dorothy": "dot dotty dolly", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora", "elizabeth": "liz lisbeth elsbeth else elise beth betty lizzie eliza libby bess betsy lisa ellie", "emily": "em emmy", "francis": "frank fran franz",
    "frances": "fran fanny", "frederick": "fred freddie freddy rick fritz frits", "gabriella": "gabi gabby ella bella", "gabriel": "gabe", "george": "georgie", "gregory": "greg", "harold": "harry hal", "helen": "nell", "henry": "harry hank hal heinz",
    "isabella": "bella izzy isa", "jacob": "jake", "james": "jakob jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "johanna": "jo hanna hanne joanna", "john": "hans jack johnny jon", "jonathan": "jon jonny nathan",
    "joseph": "joe joey sepp", "joshua": "josh", "judith": "judy", "katherine": "kathrin katja katrin kate kathy kath katie kitty kit kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "louise": "lou", "margaret": "meg peggy maggie marge greta grete gretel rita madge daisy",
    "matthew": "matt matty matthias", "michael": "michel misha mike mick mickey micky", "nathaniel": "nat nate", "nicholas": "nick nicky nico klaus nils niko", "patricia": "pat patty tricia", "patrick": "pat paddy rick", "peter": "pete", "philip": "phil pip", "rebecca": "becky becca",
    "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "samantha": "sam sammy", "stephen": "steve stevie", "susan": "sue susie", "susanne": "suse sanne susi sue susie susi sanna anne", "theodora": "thea dora theo teddy",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally", "william": "will bill billy willy liam", "zachary": "zach zack",
}
# Frequent Chinese family names of one and of two characters.
FAMILY = set("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂柴焦向柳邢岳齐梅莫庄辛管祝左涂谷祁时舒耿牟卜路詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强丛华车冉房边辜吉饶刁瞿戚丘古米池滕晋苑邬臧畅宫来嵺苟全褚廉简娄盖符奚木穆党燕郎邸冀谈姬屠连郜晏栾郁商蒙计喻揭窦迟宇敖糜鄢冷卓花仇艾蓝都巩稽井练仲乐虞卞封竺冼原官衣楚佟栗匡宗应台巫鞠僧桑荆谌银扬明沙薄伏岑习胥保和蔺")
FAMILY_TWO = {"欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "司徒", "夏侯"}
TITLES_EN = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Eng|Ing)"
TITLES_ZH = "工程师|高工|先生|女士|小姐|老师|经理|主任|主管|博士|教授"

SHORT_FORMS: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _name in (*_short.split(), _full):
        SHORT_FORMS.setdefault(_name, set()).add(_full)
GIVEN = set(SHORT_FORMS)
