"""The texts that prompts and conversations are made of. All are fixed values: readers of these texts depend on every character."""

MARKER = "Planned Trajectory:"
GOAL = "Mission Goal:"
IMAGE, VIDEO = "<image>", "<video>"
#: Headers and line leads of object prompts by filter.
OBJECTS = {
    "leading": ("Leading object detections:\n", "Leading object detected"),
    "surrounding": ("Surrounding object detections:\n", "Surrounding object detected"),
    "front": ("Front object detections:\n", "Front object detected"),
    "all": ("Full object detections:\n", "Object detected"),
}
OBJECTS_IN_RANGE = ("Object detections in X range {:.2f}-{:.2f} and Y range {:.2f}-{:.2f}:\n", "Object detected")
#: Headers, line leads and spans of trajectory prompts.
TRAJECTORIES = {
    "leading": ("Leading object future trajectory:\n", "Leading object found", "6s"),
    "ids": ("Future trajectories for specific objects:\n", "Object type", "3s"),
    "range": ("Future trajectories in X range {:.2f}-{:.2f} and Y range {:.2f}-{:.2f}:\n", "Object found", "3s"),
    "all": ("All future trajectories:\n", "Object type", "3s"),
}
WAYPOINTS = "Future waypoints of specific objects at time {}s:\n"
#: Raster prompts: headers, and what is said where there is nothing to list.
DRIVABLE, DRIVABLE_PATH, ALL_DRIVABLE = "Drivability of selected locations:\n", "Drivability of the planned trajectory:\n", "All waypoints of the planned trajectory are in drivable regions\n"
AROUND_DRIVABLE, AROUND_FREE = "- Surrounding drivable regions: ", "- Surrounding not occupied region: "
LANE_HEADER, CROSSING_HEADER = "Lane category of selected locations:\n", "Get the nearest pedestrian crossing location:\n"
OCCUPANCY, COLLISION, NO_COLLISION = "Occupancy information:\n", "Check collision of the planned trajectory:\n", "The planned trajectory does not collide with any other objects.\n"
#: Of the border on either side: headers for chosen places and for the vehicle's own, the border's name, and what is uncertain for either.
SIDES = {
    "shoulder": ("Distance to both sides of road shoulders of selected locations:\n", "Distance to both sides of road shoulders of current ego-vehicle location:\n", "shoulder", "shoulders", "shoulders"),
    "divider": ("Get distance to both sides of road lane_dividers of selected locations:\n", "Get distance to both sides of road lane_dividers of current ego-vehicle location:\n", "lane_divider", "lane_dividers", "both lane_dividers"),
}
LANES = ("divider", "ped_crossing", "boundary")
TRAFFIC_RULES = (
    "Avoid collision with other objects.",
    "Always drive on drivable regions.",
    "Avoid driving on occupied regions.",
    "Pay attention to your ego-states and historical trajectory when planning.",
    "Maintain a safe distance from the objects in front of you.",
)
#: Questions that reasoning texts answer, in order.
QUESTIONS = (
    "<What is the mission goal?>",
    "<What do you perceive in the scene?>",
    "<What is a similar past experience?>",
    "<What are the collidable objects?>",
    "<What is the driving plan?>",
    "<What are the notable objects?>",
)
PERCEPTION, EXPERIENCE = "*****Perception Results:*****", "*****Past Driving Experience for Reference:*****"
NO_EXPERIENCE, NO_SIMILAR, NONE = "\nExperience: None.\n", "\nNo similar past experience available.", "\nNone."
SELECT, SELECT_CHINESE = "Please select the correct answer from the options above.", "请直接回答选项字母。"
YES_NO, SHORT = " Please answer yes or no.", "\nPlease try to answer the question with short words or phrases if possible."
STANDARD_IO = "\nPlease write your code using Standard IO, i.e. input() and print()."
CALL_BASED = "\nPlease write your code using Call-Based format."
STARTER = "\nThe starter code is provided as below. Please finish the code.\n"
JUDGE = (
    "You are an AI assistant who will help me to match an answer with several options of a single-choice question. You are provided with a question, several options, and an answer, and you need to find which option is most similar to the answer. "
    "If the meaning of all options are significantly different from the answer, output Z. Your should output a single uppercase character in A, B, C, D (if they are valid options), and Z. \n"
    "Example 1: \nQuestion: What is the main object in image?\nOptions: A. teddy bear B. rabbit C. cat D. dog\nAnswer: a cute teddy bear\nYour output: A\n"
    "Example 2: \nQuestion: What is the main object in image?\nOptions: A. teddy bear B. rabbit C. cat D. dog\nAnswer: Spider\nYour output: Z\n"
    "Example 3: \nQuestion: "
)
