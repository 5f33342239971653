"""Skill extraction and resolution by an alias dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspectra.functions.lexicon import occurring

# --- fixed values: alias -> canonical skill name --------------------------------------
ALIASES = {
    "html": "HTML", "html5": "HTML",
    "css": "CSS", "css3": "CSS", "scss": "CSS", "sass": "CSS", "less": "CSS",
    "tailwind": "Tailwind CSS", "tailwindcss": "Tailwind CSS", "tailwind css": "Tailwind CSS",
    "bootstrap": "Bootstrap",
    "javascript": "JavaScript", "js": "JavaScript", "es6": "JavaScript",
    "es2015": "JavaScript", "ecmascript": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript",
    "react": "React", "react.js": "React", "reactjs": "React", "react js": "React",
    "redux": "Redux", "redux toolkit": "Redux", "mobx": "MobX", "zustand": "Zustand",
    "next.js": "Next.js", "nextjs": "Next.js", "next js": "Next.js", "next": "Next.js",
    "gatsby": "Gatsby", "react native": "React Native", "react-native": "React Native",
    "vue": "Vue.js", "vue.js": "Vue.js", "vuejs": "Vue.js", "vue js": "Vue.js",
    "vue3": "Vue.js", "vue 3": "Vue.js", "vuex": "Vuex", "pinia": "Pinia",
    "nuxt": "Nuxt.js", "nuxt.js": "Nuxt.js", "nuxtjs": "Nuxt.js",
    "angular": "Angular", "angularjs": "Angular", "angular.js": "Angular",
    "rxjs": "RxJS", "ngrx": "NgRx",
    "webpack": "Webpack", "vite": "Vite", "rollup": "Rollup", "parcel": "Parcel",
    "esbuild": "esbuild", "babel": "Babel", "swc": "SWC",
    "jest": "Jest", "vitest": "Vitest", "cypress": "Cypress", "playwright": "Playwright",
    "testing library": "Testing Library", "react testing library": "Testing Library",
    "rtl": "Testing Library", "storybook": "Storybook", "selenium": "Selenium",
    "puppeteer": "Puppeteer",
    "graphql": "GraphQL", "apollo": "Apollo", "rest api": "REST API", "rest": "REST API",
    "axios": "Axios", "fetch api": "Fetch API", "tanstack query": "TanStack Query",
    "react query": "TanStack Query", "swr": "SWR",
    "material ui": "Material UI", "mui": "Material UI", "ant design": "Ant Design",
    "antd": "Ant Design", "chakra ui": "Chakra UI", "styled-components": "Styled Components",
    "styled components": "Styled Components", "css modules": "CSS Modules",
    "css-in-js": "CSS-in-JS", "emotion": "Emotion", "shadcn": "shadcn/ui",
    "git": "Git", "github": "GitHub", "gitlab": "GitLab", "ci/cd": "CI/CD", "ci cd": "CI/CD",
    "docker": "Docker",
    "node.js": "Node.js", "nodejs": "Node.js", "node": "Node.js",
    "npm": "npm", "yarn": "Yarn", "pnpm": "pnpm", "figma": "Figma",
    "responsive": "Responsive Design", "responsive design": "Responsive Design",
    "адаптивная вёрстка": "Responsive Design", "адаптивная верстка": "Responsive Design",
    "кроссбраузерность": "Cross-browser", "cross-browser": "Cross-browser",
    "accessibility": "Accessibility", "a11y": "Accessibility", "seo": "SEO", "ssr": "SSR",
    "pwa": "PWA", "web components": "Web Components", "webgl": "WebGL",
    "three.js": "Three.js", "d3": "D3.js", "d3.js": "D3.js", "recharts": "Recharts",
    "echarts": "ECharts", "chart.js": "Chart.js", "websocket": "WebSocket",
    "websockets": "WebSocket", "socket.io": "Socket.IO",
    "agile": "Agile", "scrum": "Scrum", "kanban": "Kanban", "jira": "Jira",
    "верстка": "HTML/CSS вёрстка", "вёрстка": "HTML/CSS вёрстка",
    "pixel perfect": "Pixel Perfect", "бэм": "BEM", "bem": "BEM",
    "svelte": "Svelte", "solid": "SolidJS", "solidjs": "SolidJS", "astro": "Astro",
    "remix": "Remix", "microfrontend": "Micro Frontends", "micro frontend": "Micro Frontends",
    "микрофронтенд": "Micro Frontends", "monorepo": "Monorepo", "turborepo": "Turborepo",
    "nx": "Nx", "lerna": "Lerna", "redux-saga": "Redux Saga", "redux saga": "Redux Saga",
    "effector": "Effector", "recoil": "Recoil", "formik": "Formik",
    "react hook form": "React Hook Form", "zod": "Zod", "yup": "Yup", "i18n": "i18n",
    "интернационализация": "i18n", "eslint": "ESLint", "prettier": "Prettier",
    "lint": "Linting", "husky": "Husky",
}
# -------------------------------------------------------------------------------------


def by_priority(aliases: dict[str, str] = ALIASES) -> list[str]:
    """Longer aliases first; equal lengths keep dictionary order."""
    return sorted(aliases, key=len, reverse=True)


def extract_skills(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Canonical skills named in a text as whole words, in order of alias priority."""
    ordered = by_priority(aliases)
    names = F.array(*[F.lit(aliases[a]) for a in ordered])
    ranks = occurring(F.lower(text), ordered, whole_words=True)
    return F.array_distinct(F.transform(ranks, lambda r: F.get(names, r)))


def resolve_alias(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Canonical spelling of one skill name, or the trimmed name itself."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.trim(name))
